"""Sources: file trees, JSON-line logs, chat payloads, configuration."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import qualified

# Languages by extension, folders that are passed over, suffixes of documents that need a converter and of those that are text.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust",
    ".java": "java", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "c_sharp",
}
IGNORED = [".git", ".ctx", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", "target", ".idea", ".vscode"]
CONVERTIBLE = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".html", ".htm"]
TEXTLIKE = [".txt", ".md", ".markdown", ".csv", ".json", ".rst"]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix(path)]


def is_convertible(path: Column) -> Column:
    return suffix(path).isin(*CONVERTIBLE, *TEXTLIKE)


def is_source(path: Column) -> Column:
    """Whether a relative path is a source file outside the ignored folders."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED))) & language(path).isNotNull()


def _literal(path: str) -> str:
    """A path whose pattern characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _under(spark: SparkSession, root: str, keep) -> DataFrame:
    """path (relative to root) and content of the files for whose path the condition keep(path) holds; others are listed, never read."""
    base = qualified(spark, root).rstrip("/")
    relative = F.substr(F.col("path"), F.lit(len(base) + 2))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_literal(base)).select("path")
    # The driver holds the listing of a tree in any case; of it, the kept paths.
    wanted = [_literal(r["path"]) for r in listed.filter(keep(relative)).toLocalIterator()]
    if not wanted:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(wanted).select(relative.alias("path"), "content")


def utf8(content: Column) -> Column:
    """Bytes as text, with U+FFFD for bad ones."""
    return F.make_valid_utf8(content.cast("string"))


def parsed_texts(files: DataFrame) -> DataFrame:
    """path, text, hash, lang of files (path, content): UTF-8 with bad bytes replaced, line ends made one kind."""
    text = F.regexp_replace(utf8(F.col("content")), "\r\n?", "\n")
    return files.select("path", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("hash"), language(F.col("path")).alias("lang"))


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), text, hash, lang of the source files under root; ignored folders count from the root on."""
    return parsed_texts(_under(spark, root, is_source))


def document_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative) and content of the documents under root that can be converted."""
    return _under(spark, root, is_convertible)


def _json_lines(lines: DataFrame, schema: str, required: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the lines that are objects with exactly these keys; all others are skipped."""
    lines = lines.select("value", F.monotonically_increasing_id().alias("pos"))
    keys = F.array_sort(F.json_object_keys("value"))
    ok = F.lit(False)
    for extra in [[], *([k] for k in optional)]:
        ok = ok | (keys == F.array(*map(F.lit, sorted([*required, *extra]))))
    return lines.filter(F.coalesce(ok, F.lit(False))).select(F.from_json("value", schema).alias("r"), "pos").select("r.*", "pos")


DECISION = "decision string, rationale string, files_touched array<string>, timestamp double"
REQUEST = "ts double, model string, fresh_in bigint, cached_in bigint, out bigint, cache_hit_rate double, cost_usd double, command string"


def decisions(lines: DataFrame) -> DataFrame:
    """The log's entries; `pos` is their order within a file."""
    return _json_lines(lines, DECISION, ["decision", "rationale", "files_touched", "timestamp"])


def requests(lines: DataFrame) -> DataFrame:
    out = _json_lines(lines, REQUEST, ["ts", "model", "fresh_in", "cached_in", "out", "cache_hit_rate", "cost_usd"], ("command",))
    return out.withColumn("command", F.coalesce("command", F.lit(""))).drop("pos")


def _flat(body: Column, between: str) -> Column:
    """A string as it is; of a list the texts of its objects, joined; empty for anything else. Told by the JSON type, not by its looks."""
    kind = F.schema_of_variant(body)
    part = lambda p: F.coalesce(F.when(F.schema_of_variant(p).startswith("OBJECT"), F.try_variant_get(p, "$.text", "string")), F.lit(""))
    whole = F.filter(F.try_variant_get(body, "$", "array<variant>"), lambda p: F.schema_of_variant(p).startswith("OBJECT"))
    return F.coalesce(F.when(kind == "STRING", F.try_variant_get(body, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(F.transform(whole, part), between)), F.lit(""))


def payload_turns(payloads: DataFrame) -> DataFrame:
    """conv_id, turn, role, content of chat payloads (conv_id, payload JSON): a content that is a list gives its parts' texts."""
    messages = F.try_variant_get(F.try_parse_json("payload"), "$.messages", "array<variant>")
    raw = payloads.select("conv_id", F.posexplode(messages).alias("turn", "m"))
    return raw.select("conv_id", "turn", F.coalesce(F.try_variant_get("m", "$.role", "string"), F.lit("user")).alias("role"), _flat(F.try_variant_get("m", "$.content", "variant"), "").alias("content"))


def payload_system(payloads: DataFrame) -> DataFrame:
    """conv_id, system: the texts of a list stand on lines of their own."""
    return payloads.select("conv_id", _flat(F.try_variant_get(F.try_parse_json("payload"), "$.system", "variant"), "\n").alias("system"))


def project_root(start: str) -> Path:
    """The nearest folder above that holds .ctx or .git, else the start."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / ".ctx").exists() or (p / ".git").exists()), here)


@dataclass(frozen=True)
class Budgets:
    """The window, what is left for the answer, and each layer's share of the rest."""

    window: int = 200_000
    generation_reserve: int = 8_000
    repo_map: float = 0.20
    decision_log: float = 0.10
    snippets: float = 0.35
    verbatim: float = 0.35

    def share(self, layer: str) -> int:
        return int(max(1, self.window - self.generation_reserve) * getattr(self, layer))


@dataclass(frozen=True)
class Config:
    budgets: Budgets = field(default_factory=Budgets)
    models: dict[str, str] = field(default_factory=lambda: {"frontier": "top", "cheap_cloud": "small", "local": "local"})
    enabled_commands: tuple[str, ...] = ()


def load_config(path: str) -> Config:
    """Defaults where the file is missing; an unknown budget raises."""
    p = Path(path)
    if not p.exists():
        return Config()
    raw = tomllib.loads(p.read_text())
    given = raw.get("budgets", {})
    if unknown := set(given) - {f.name for f in fields(Budgets)}:
        raise TypeError(f"unknown budgets: {sorted(unknown)}")
    return Config(Budgets(**given), Config().models | raw.get("models", {}), tuple(raw.get("enabled_commands", ())))


def write_config(c: Config, path: str) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(config_toml(c))


def config_toml(c: Config) -> str:
    rows = ["[budgets]", *(f"{f.name} = {getattr(c.budgets, f.name)}" for f in fields(Budgets)), "", "[models]", *(f'{k} = "{v}"' for k, v in c.models.items())]
    return f"enabled_commands = [{', '.join(f'"{x}"' for x in c.enabled_commands)}]\n\n" + "\n".join(rows) + "\n"
