"""Repairs of extracted texts, each one a row of a log that leads from the text as it came to the text as it is kept.

A step reads a text and gives edits: replace ``length`` characters at ``start``. A step's edits do not
overlap and count positions in the text that the step began with, so a log is replayed step by step
(``replay``) and a reader can tell from it where every kept character came from.

Texts are repaired each in its own task, in one pass over its lines; nothing is shuffled. Defined
results: null texts stay null and have no log; empty texts stay empty; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.compat import bound

Edit = tuple[int, int, str, str]  # start, end, replacement, kind

# What the steps look for.
DIVIDER = re.compile(r"[ _\-–—=~*•·.]{4,}")
GLUED = re.compile(r"([а-яё])(?=[А-ЯЁ][а-яё])")
BEHIND_BRACKET = re.compile(r"[)»”](?=[А-ЯЁ][а-яё])")
BEHIND_STOP = re.compile(r"[.!?…](?=[А-ЯЁ][а-яё])")
CAPITALS = re.compile(r"[А-ЯЁA-Z]")
LOWER = re.compile(r"[а-яёa-z]")
DANGLING = re.compile(r"(?ia)\b(в|на|и|для|от|до|по|с|у|о|об|из|к|за|под|над|при|без|или|а|но|что|как|the|of|and|for|to|in|on|with)\s*$")
CLOSED = re.compile(r"[.!?…:;,)\]]\s*$")
SENTENCE_END = re.compile(r"\n+|(?<=[.!?…])\s+")
LEAST_LINE, LEAST_SENTENCE, LEAST_REPEAT, LEAST_SUMMARY = 8, 8, 20, 12


def _lines(text: str) -> list[tuple[int, int, str]]:
    """(start, end, line) of each line."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line), line))
        at += len(line) + 1
    return out


def applied(text: str, edits: list[Edit]) -> str:
    pieces, at = [], 0
    for start, end, new, _ in edits:
        pieces += [text[at:start], new]
        at = end
    return "".join([*pieces, text[at:]])


def without_dividers(text: str) -> list[Edit]:
    """Lines of nothing but rules and dots go, each with the line end before it, or behind it at the start."""
    rows = _lines(text)
    gone = [bool(DIVIDER.fullmatch(line.strip())) for _, _, line in rows]
    kept_before, out = False, []
    for (start, end, _), drop in zip(rows, gone):
        if drop:
            out.append((start - 1, end, "", "stripped-divider") if kept_before else (start, min(end + 1, len(text)), "", "stripped-divider"))
        kept_before = kept_before or not drop
    return out


def _compound(text: str, start: int, end: int) -> bool:
    """A word with two capitals or more inside is a name of its own."""
    while start and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return len(CAPITALS.findall(text, start + 1, end)) >= 2


def unglued(text: str) -> Iterator[list[Edit]]:
    """Words that lost the sentence break between them, in three steps. Latin ones may be names and are left."""
    edits = []
    for m in GLUED.finditer(text):
        high = m.end() + 1
        while high < len(text) and LOWER.match(text[high]) and text[high] > "z":
            high += 1
        if not _compound(text, m.start(), high):
            edits.append((m.end(), m.end(), ". ", "unglued"))
    yield edits
    text = applied(text, edits)
    edits = [(m.end(), m.end(), ". ", "unglued") for m in BEHIND_BRACKET.finditer(text)]
    yield edits
    text = applied(text, edits)
    yield [(m.end(), m.end(), " ", "unglued") for m in BEHIND_STOP.finditer(text)]


def _shouted(line: str) -> bool:
    letters = len(CAPITALS.findall(line))
    return letters >= 3 and letters / len("".join(line.split())) > 0.6 and line == line.upper()


def joined_lines(text: str) -> list[Edit]:
    """Lines that are pieces of one: a colon that lost its heading, a word broken at its hyphen, headings in capitals
    behind a colon, and a line that stops at a single word or a preposition before a lower-case one."""
    rows, out, i = _lines(text), [], 0
    while i < len(rows):
        start, end, line = rows[i]
        if i and line.lstrip().startswith(":"):
            out.append((start - 1, start, "", "joined-fragments"))
            i += 1
            continue
        head, following = line.rstrip(), rows[i + 1][2].strip() if i + 1 < len(rows) else ""
        last, merged = i + 1, None
        if following:
            goes_on = bool(LOWER.match(following))
            if head.endswith("-") and goes_on:
                merged = head[:-1].rstrip() + "-" + following
            elif head.endswith(":") and _shouted(head) and _shouted(following):
                parts = [head]
                while last < len(rows) and _shouted(rows[last][2].strip()):
                    parts.append(rows[last][2].strip())
                    last += 1
                merged, last = re.sub(r"\s{2,}", " ", " ".join(parts)), last - 1
            elif head and goes_on and not CLOSED.search(head) and (len(head) <= 15 and not any(map(str.isspace, head)) or DANGLING.search(head)):
                merged = f"{head} {following}"
        if merged is None:
            i += 1
        else:
            out.append((start, rows[last][1], merged, "joined-fragments"))
            i = last + 1
    return out


def single_lines(text: str) -> list[Edit]:
    """Lines of LEAST_LINE characters that stood before go; the others are trimmed."""
    seen: set[str] = set()
    out: list[Edit] = []
    for start, end, line in _lines(text):
        bare = line.strip()
        left = len(line) - len(line.lstrip())
        if len(bare) >= LEAST_LINE and bare.lower() in seen:
            out.append((start - 1, end, "", "deduped-lines"))  # never the first
            continue
        if len(bare) >= LEAST_LINE:
            seen.add(bare.lower())
        if left:
            out.append((start, start + left, "", "tidied"))
        if len(bare) + left < len(line):
            out.append((start + left + len(bare), end, "", "tidied"))
    return out


def tidied(text: str) -> list[Edit]:
    """No more than one empty line between others, none at either end."""
    body = text.strip()
    low = len(text) - len(text.lstrip()) if body else len(text)
    out = [(0, low, "", "tidied")] if low else []
    out += [(low + m.start() + 2, low + m.end(), "", "tidied") for m in re.finditer(r"\n{3,}", body)]
    return [*out, (low + len(body), len(text), "", "tidied")] if low + len(body) < len(text) else out


def single_sentences(text: str) -> list[Edit]:
    """Sentences said before go: in a run of two or three that is repeated, or alone if LEAST_REPEAT characters long or
    said three times. A line of sentences is written anew without those under LEAST_SENTENCE characters."""
    rows = [(start, end, line, [s for x in SENTENCE_END.split(line) if len(s := " ".join(x.split())) >= LEAST_SENTENCE]) for start, end, line in _lines(text)]
    flat = [s.lower() for *_, sentences in rows for s in sentences]
    counts, dropped = Counter(flat), set()
    for length in (3, 2):
        first: set[tuple] = set()
        for i in range(len(flat) - length + 1):
            run = tuple(flat[i : i + length])
            if run in first:
                dropped.update(range(i, i + length))
            first.add(run)
    seen, at, out = set(), 0, []
    for start, end, line, sentences in rows:
        kept, repeated = [], False
        for s in sentences:
            key = s.lower()
            if at in dropped or key in seen and (len(s) >= LEAST_REPEAT or counts[key] >= 3):
                repeated = True
            else:
                seen.add(key)
                kept.append(s)
            at += 1
        if sentences and (new := " ".join(kept)) != line:
            out.append((start, end, new, "deduped-sentences" if repeated else "tidied"))
    return out


def without_span(text: str, said: str | None) -> list[Edit]:
    """The first place where ``text`` says ``said`` (LEAST_SUMMARY characters or more), case and white space aside,
    becomes a line end. Places are found in the normalised text and mapped back."""
    needle = " ".join((said or "").split()).lower()
    if len(needle) < LEAST_SUMMARY:
        return []
    chars, places, gap = [], [], False
    for i, c in enumerate(text):
        if c.isspace():
            gap = bool(chars)
            continue
        low = c.lower()
        if gap:
            chars.append(" ")
            places.append(i)
        chars.append(low)
        places += [i] * len(low)
        gap = False
    at = "".join(chars).find(needle)
    return [] if at < 0 else [(places[at], places[at + len(needle) - 1] + 1, "\n", "deduped-lines")]


def repaired(text: str, summary: str | None = None) -> tuple[str, list[tuple[int, int, str, int, int, str]]]:
    """The text as it is kept, and its log: step, ord, kind, start, length, replacement."""
    log, step = [], 0

    def take(edits: list[Edit]) -> None:
        nonlocal text, step
        log.extend((step, i, kind, start, end - start, new) for i, (start, end, new, kind) in enumerate(edits))
        text, step = applied(text, edits), step + 1

    take(without_span(text, summary))
    take(without_dividers(text))
    for edits in unglued(text):
        take(edits)
    for edits_of in (joined_lines, single_lines, tidied, single_sentences):
        take(edits_of(text))
    take([(m.start() + 2, m.end(), "", "tidied") for m in re.finditer(r"\n{3,}", text)])
    return text, log


_LOG = pa.list_(pa.struct([("step", pa.int32()), ("ord", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("replacement", pa.string())]))


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):  # one text at a time, however long
            text, summary = batch.column("text")[row].as_py(), batch.column("summary")[row].as_py()
            kept, log = (None, []) if text is None else repaired(text, summary)
            entries = [dict(zip(("step", "ord", "kind", "start", "length", "replacement"), entry, strict=True)) for entry in log]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([kept], pa.string()), pa.array([entries], _LOG)], names=["key", "repaired", "log"])


def repair(docs: DataFrame, key: str = "doc_id", text: str = "text", summary: Column | None = None) -> DataFrame:
    """``key``, repaired and log (array of step, ord, kind, start, length, replacement) for each text."""
    kind = docs.schema[key].dataType.simpleString()
    said = summary if summary is not None else F.lit(None)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), said.cast("string").alias("summary"))
    out = rows.mapInArrow(_repair, f"key {kind}, repaired string, log array<struct<step:int,ord:int,kind:string,start:int,length:int,replacement:string>>")
    return out.withColumnRenamed("key", key)


def replay(text: str, log) -> str:
    """A text by its log, from the first step to the last."""
    for step in sorted({e["step"] for e in log}):
        text = applied(text, [(e["start"], e["start"] + e["length"], e["replacement"], e["kind"]) for e in sorted(log, key=lambda e: e["ord"]) if e["step"] == step])
    return text


def deduplicated_lines(text: Column) -> Column:
    """The lines of a text, trimmed, without those of LEAST_LINE characters that stood before; native."""
    # A line's first place comes from a sort of the lines, so long texts take no time by their square.
    trimmed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("i")))
    keyed = F.array_sort(F.transform(trimmed, lambda x: F.struct(F.when(F.length(x["line"]) >= LEAST_LINE, F.lower(x["line"])).alias("key"), x["i"].alias("i"), x["line"].alias("line"))))
    before = lambda s: F.concat(F.slice(s, 1, 1), s)
    first = lambda s: F.filter(F.zip_with(s, F.slice(before(s), 1, F.size(s)), lambda x, y: F.when(x["key"].isNull() | (x["i"] == y["i"]) | ~x["key"].eqNullSafe(y["key"]), F.struct(x["i"].alias("i"), x["line"].alias("line")))), lambda x: x.isNotNull())
    return F.array_join(F.transform(F.array_sort(bound(keyed, first)), lambda x: x["line"]), "\n")
