"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory above.

Segments of a text (each line, each paragraph, the whole) are compared with licence templates as
sparse TF-IDF vectors. Document frequencies of the templates' terms are counted over all texts;
other words weigh as unseen ones. A segment that reaches THRESHOLD speaks for the best template
whose distinguishing marks it holds (a version, "affero", a third clause); if another licence with
its own marks comes within MARGIN, the segment says nothing. A file has its own licence if a segment
names one, the best score deciding; it is a licence file if its name says so or the matching parts
hold half of its words. A licence file speaks for its directory and those below; a file without a
licence of its own takes that of the nearest directory above it that has one, found by joining on
every ancestor path.

Only segments that hold one of CUES are scored, and texts without any never leave the JVM.

Defined results: null texts are empty and have no licence of their own; a null path has no
directory; among equal scores the first segment decides, among licence files of one directory
the best score, then the least path; repeated rows get equal results; other columns stay behind; an
empty table gives an empty table; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop, materialize, text_of
from .license_texts import Template, templates

THRESHOLD = 0.6
MARGIN = 0.02
FILE_SHARE = 0.5
BROADCAST_DIRECTORIES = 200_000
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$"
#: A segment without any of these, in lower case, says nothing of a licence.
CUES = ("licen", "gpl", "redistribution", "permission", "unencumbered", "misrepresented", "'as-is'", "plainly", "endorse", "copyright", "cc0", "cc by", "cc-by", "commons")
TEMPLATES = templates()

_WORD = re.compile("[a-z0-9]+")
_CUE = re.compile("|".join(map(re.escape, CUES)))
_SIGNS = re.compile(r"(?m)^[\s*#/;%!>|-]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def plain(segment: str) -> str:
    """In lower case, on one line, without the signs that comments begin with."""
    return " ".join(_SIGNS.sub(" ", segment.lower()).split())


def _holds(pattern: str, text: str) -> bool:
    """Patterns made of look-aheads speak of the whole; they are tried at its start only."""
    return bool((re.match if pattern.startswith("(?") else re.search)(pattern, text))


class Matcher:
    """Template vectors and their cosines with a segment."""

    def __init__(self, known: list[Template], documents: int, frequency: dict[str, int]) -> None:
        self.templates = known
        self.unseen = math.log(documents + 1) + 1
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1 for t in known for w in words(t.text)}
        postings: dict[str, list[tuple[int, float]]] = {}
        for i, t in enumerate(known):
            weight = {w: c * self.idf[w] for w, c in Counter(words(t.text)).items()}
            norm = math.sqrt(sum(v * v for v in weight.values()))
            for w, v in weight.items():
                postings.setdefault(w, []).append((i, v / norm))
        self.postings = {w: (np.array([i for i, _ in x]), np.array([v for _, v in x])) for w, x in postings.items()}

    def cosines(self, segment: str) -> np.ndarray:
        counts = Counter(words(segment))
        norm = math.sqrt(sum((c * self.idf.get(w, self.unseen)) ** 2 for w, c in counts.items())) or 1.0
        scores = np.zeros(len(self.templates))
        for w, c in counts.items():
            if w in self.postings:
                places, values = self.postings[w]
                scores[places] += values * (c * self.idf[w] / norm)
        return np.round(scores, 12)

    def verdict(self, segment: str, whole: str) -> tuple[str | None, float]:
        """The licence a segment speaks for, and its cosine; whole is the whole text, made plain."""
        scores = self.cosines(segment)
        near = np.flatnonzero(scores >= THRESHOLD)
        own, told, found = plain(segment), {}, None
        for i in near[np.lexsort((near, -scores[near]))].tolist():
            t = self.templates[i]
            if found and (t.name == found[0] or scores[i] <= found[1] - MARGIN):
                if t.name != found[0]:
                    break
                continue
            rule = (t.marks, t.scope, t.without)
            if rule not in told:
                told[rule] = _holds(t.marks, own) and (not t.scope or _holds(t.scope, whole)) and not (t.without and _holds(t.without, whole))
            if told[rule]:
                if found:
                    # Of several tags on one line the first counts; of two wordings as near as each other none does.
                    return found if t.tag else (None, 0.0)
                found = (t.name, float(scores[i]))
        return found or (None, 0.0)

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """Licence, its score, and the share of the text's words in matching parts."""
        if not text or not _CUE.search(text.lower()):
            return None, 0.0, 0.0
        whole, best, inside = plain(text), (None, 0.0), 0

        def heard(segment: str) -> int:
            """Words of a segment that speaks for a licence, else 0."""
            nonlocal best
            name, score = self.verdict(segment, whole) if _CUE.search(segment.lower()) else (None, 0.0)
            if name and score > best[1]:
                best = (name, score)
            return len(segment.split()) if name else 0

        paragraphs = list(_paragraphs(text))
        for lines in paragraphs:
            together = "\n".join(lines)
            if _CUE.search(together.lower()):
                by_line = sum(map(heard, lines))
                inside += max(by_line, heard(together) if len(lines) > 1 else 0)
        if len(paragraphs) > 1:
            inside = max(inside, heard(text))
        return (*best, min(1.0, inside / max(1, len(text.split()))))


def _paragraphs(text: str):
    """Lists of lines; a line without letters or digits parts them."""
    lines: list[str] = []
    for line in text.split("\n"):
        if any(map(str.isalnum, line)):
            lines.append(line)
        elif lines:
            yield lines
            lines = []
    if lines:
        yield lines


def _frequency(files: DataFrame, known: list[Template]) -> tuple[int, dict[str, int]]:
    """How many texts there are, and how many hold each term of the templates; counted in the JVM, combined before the shuffle."""
    terms = F.expr("array(" + ",".join(f"'{w}'" for w in sorted({w for t in known for w in words(t.text)})) + ")")
    held = F.array_intersect(F.split(F.lower(text_of()), "[^a-z0-9]+"), terms)
    # An empty name stands for the text itself, so that one pass counts both.
    rows = files.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def _cued(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for cue in CUES:
        found = found | F.contains(low, F.lit(cue))
    return found


def own(files: DataFrame, known: list[Template] = TEMPLATES) -> DataFrame:
    """files: id, path, text. id, path, license, score, share of each file by itself."""
    matcher = Matcher(known, *_frequency(files, known))

    def run(batch):
        found = [matcher.scan(t) for t in batch.column(2).to_pylist()]
        return {"id": batch.column(0), "path": batch.column(1), "license": [f[0] for f in found], "score": np.array([f[1] for f in found], float), "share": np.array([f[2] for f in found], float)}

    text = F.when(_cued(text_of()), text_of()).otherwise("")
    rows = files.select(F.col("id").cast("long").alias("id"), F.col("path").cast("string").alias("path"), text.alias("text"))
    return arrow_map(rows, run, "id long, path string, license string, score double, share double")


def ancestors(path):
    """Every directory above a path, nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))


def scan(files: DataFrame, known: list[Template] = TEMPLATES) -> DataFrame:
    """id, path, own_license, score, inherited_license, from_dir, license (own, else inherited), decided_by (own, inherited or null)."""
    found = materialize(own(files, known), "licenses")
    holders = found.filter(F.col("license").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(FILE_NAME) | (F.col("share") >= FILE_SHARE)))
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    best = F.min(F.struct((-F.col("score")).alias("minus"), "path", "license")).alias("best")
    by_dir = holders.groupBy(directory.alias("dir")).agg(best).select("dir", F.col("best.license").alias("theirs"))
    by_dir = directories = materialize(by_dir, "directories", shrink=8)
    if by_dir.count() <= BROADCAST_DIRECTORIES:
        by_dir = F.broadcast(by_dir)
    # Few paths for each directory: ancestors are joined once per directory, not once per file.
    bare = found.filter("license is null and path is not null").select(directory.alias("place")).distinct()
    above = bare.select("place", F.explode(ancestors(F.concat("place", F.lit("/x")))).alias("a"))
    above = above.select("place", "a.depth", F.regexp_replace("a.dir", "^/", "").alias("dir"))
    nearest = above.join(by_dir, "dir").groupBy("place").agg(F.max(F.struct("depth", "dir", "theirs")).alias("n"))
    nearest = materialize(nearest.select("place", F.col("n.dir").alias("from_dir"), F.col("n.theirs").alias("theirs")), "nearest", shrink=8)
    drop(directories)
    if nearest.count() <= BROADCAST_DIRECTORIES:
        nearest = F.broadcast(nearest)
    out = found.withColumn("place", F.when(F.col("license").isNull(), directory)).join(nearest, "place", "left")
    decided = F.when(F.col("license").isNotNull(), "own").when(F.col("theirs").isNotNull(), "inherited")
    return out.select(
        "id",
        "path",
        F.col("license").alias("own_license"),
        "score",
        F.col("theirs").alias("inherited_license"),
        "from_dir",
        F.coalesce("license", "theirs").alias("license"),
        decided.alias("decided_by"),
    )
