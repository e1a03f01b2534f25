"""Search/replace edits: parsing blocks, locating anchors, applying hunks."""

from __future__ import annotations

import difflib
from collections import Counter
from itertools import accumulate
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: an edit block's form (path line, 5 to 7 marker characters).
BLOCK = r"(?smd)^([^\n]*?)\n<{5,7} SEARCH\n(.*?)\n?={5,7}\n(.*?)\n?>{5,7} REPLACE"
THRESHOLD = 0.7


def parse_blocks(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, hunk_idx, path, search, replace."""
    group = lambda g: F.regexp_extract_all(text, F.lit(BLOCK), F.lit(g))
    zipped = F.arrays_zip(group(1).alias("path"), group(2).alias("search"), group(3).alias("replace"))
    out = texts.select(key, F.posexplode(zipped).alias("hunk_idx", "h"))
    return out.select(key, "hunk_idx", F.trim(F.regexp_replace("h.path", r"^\s+|\s+$", "")).alias("path"), "h.search", "h.replace")


def _bound(a: Counter, b: Counter) -> float:
    """No similarity of two strings with these characters is greater."""
    size = a.total() + b.total()
    return 2 * (a & b).total() / size if size else 1.0


def locate(text: str, anchor: str, threshold: float = THRESHOLD) -> tuple[int, int, float] | None:
    """start, end, similarity of the place most like the anchor, the first of equals, or None below the threshold.

    A verbatim place is best. Otherwise stretches of as many lines as the anchor has are compared, all lines stripped, in the
    order of the most that their characters allow; once that is less than the best similarity, no other can win.
    """
    verbatim = text.find(anchor)
    if verbatim >= 0:
        return verbatim, verbatim + len(anchor), 1.0
    wanted = [x.strip() for x in anchor.splitlines()]
    rows = text.splitlines(keepends=True)
    ends = list(accumulate(map(len, rows)))
    bare = [x.strip() for x in rows]
    goal = "\n".join(wanted)
    letters = Counter(goal)
    stretches = [(first, "\n".join(bare[first : first + len(wanted)])) for first in range(max(1, len(rows) - len(wanted) + 1))]
    hopes = sorted(((_bound(Counter(s), letters), -first, s) for first, s in stretches), reverse=True)
    best = (-1.0, 0)
    compare = difflib.SequenceMatcher(None, "", goal)
    for hope, minus_first, stretch in hopes:
        if hope < max(best[0], threshold):
            break
        compare.set_seq1(stretch)
        best = max(best, (compare.ratio(), minus_first))
    if best[0] < threshold:
        return None
    first = -best[1]
    after = min(first + len(wanted), len(rows))
    return (ends[first - 1] if first else 0), (ends[after - 1] if after else 0), best[0]


def _outside(path: str) -> bool:
    return path.startswith("/") or ".." in path.split("/")


def _change(text: str | None, hunk, keep_newline: bool, threshold: float) -> tuple[str, float, str | None]:
    """What becomes of a file's text: state, similarity, and the new text if the hunk fits."""
    if _outside(hunk.path):
        return "outside", 0.0, None
    if text is None:
        return ("missing", 0.0, None) if hunk.search.strip() else ("created", 1.0, hunk.replace)
    place = locate(text, hunk.search, threshold)
    if place is None:
        return "unmatched", 0.0, None
    start, end, ratio = place
    tail = text[end:]
    if keep_newline and ratio < 1 and text[start:end].endswith("\n") and not hunk.replace.endswith("\n"):
        tail = "\n" + tail
    return "replaced", ratio, text[:start] + hunk.replace + tail


DETAILS = {"outside": "path is outside of the project", "missing": "there is no such file", "created": "file is new", "unmatched": "no place is similar enough", "replaced": "similarity {0:.2f}"}


def _fold(keep_newline: bool, dry_run: bool, threshold: float):
    def run(key, hunks, files):
        import pandas as pd

        text = files["text"].iloc[0] if len(files) else None
        out = []
        for hunk in hunks.sort_values(["doc_id", "hunk_idx"], kind="stable").itertuples():
            state, ratio, new = _change(text, hunk, keep_newline, threshold)
            detail = ("trial: " if dry_run and new is not None else "") + DETAILS[state].format(ratio)
            out.append((hunk.doc_id, hunk.hunk_idx, hunk.path, new is not None, detail, float(ratio), new))
            text = new if new is not None and not dry_run else text
        return pd.DataFrame(out, columns=["doc_id", "hunk_idx", "path", "ok", "detail", "ratio", "new_text"])

    return run


def apply_hunks(hunks: DataFrame, files: DataFrame, threshold: float = THRESHOLD, dry_run: bool = False, keep_newline: bool = True) -> DataFrame:
    """doc_id, hunk_idx, path, ok, detail, ratio, new_text. Hunks of one file see what earlier ones did; files are (path, text).

    keep_newline keeps the line end of a window that was matched approximately; without it the next line is glued on.
    """
    kind = hunks.schema["doc_id"].dataType.simpleString()
    wanted = files.select("path", "text").join(hunks.select("path").distinct(), "path", "left_semi")
    return hunks.groupBy("path").cogroup(wanted.groupBy("path")).applyInPandas(_fold(keep_newline, dry_run, threshold), f"doc_id {kind}, hunk_idx int, path string, ok boolean, detail string, ratio double, new_text string")


def outcomes(texts: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each text: ok, good, total; a text without blocks has failed."""
    per = results.groupBy(key).agg(F.bool_and("ok").alias("all_ok"), F.count_if("ok").alias("good"), F.count("*").alias("total"))
    zero = F.lit(0).cast("long")
    return texts.select(key).join(per, key, "left").select(key, F.coalesce("all_ok", F.lit(False)).alias("ok"), F.coalesce("good", zero).alias("good"), F.coalesce("total", zero).alias("total"))


def final_texts(results: DataFrame) -> DataFrame:
    """path, new_text after the last hunk that applied; write_files() is its sink."""
    return results.filter("new_text IS NOT NULL").groupBy("path").agg(F.max_by("new_text", F.struct("doc_id", "hunk_idx")).alias("new_text"))


def write_files(finals: DataFrame, root: str) -> list[str]:
    """Writes final texts below root, file after file as they come to the driver; folders are made. Paths that leave it are passed over."""
    done = []
    for r in finals.orderBy("path").toLocalIterator():
        if not _outside(r["path"]):
            target = Path(root) / r["path"]
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(r["new_text"], encoding="utf-8")
            done.append(r["path"])
    return done


def make_block(path: str, search: str, replace: str) -> str:
    marks = {k: k * 7 for k in "<=>"}
    return f"{path}\n{marks['<']} SEARCH\n{search}\n{marks['=']}\n{replace}\n{marks['>']} REPLACE"


def instructions() -> str:
    """What a model is told about the form of edits."""
    return "Write changes as edit blocks, one for each place:\n" + make_block("folder/name.py", "lines as they are now", "lines as they should be") + "\nAn empty upper half makes a new file."
