"""Content blocks kept as JSON: an editor sees the fields that it knows, all else goes through untouched.

A block is edited in its text: the values of edited members are replaced where they stand, members that
are taken away go with their comma, new ones come last. Every other byte, numbers, escapes, order,
repeated names and white space included, is as it was. Defined results: a null block stays null; a block
that is no JSON object stays as it is, is unsupported and has no fields; an edit of a field that the
block's type does not know is ignored, as is one that is no JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The fields that the editor shows for each type of block, and types that it knows without any.
FIELDS = {
    "hero": ("title", "description", "buttonLabel", "buttonUrl", "media", "image"),
    "richtext": ("heading", "content", "items", "caption"),
    "text": ("content", "heading"),
    "heading": ("heading", "title", "content", "level"),
    "list": ("heading", "items"),
    "features": ("heading", "items"),
    "cta": ("title", "heading", "description", "content", "buttonLabel", "buttonUrl"),
    "gallery": ("heading", "caption", "media", "items"),
    "media": ("caption", "media", "src"),
    "facts": ("heading", "items"),
    "faq": ("heading", "items"),
    "table": ("heading", "rows", "items"),
    "quote": ("content", "caption"),
    "steps": ("heading", "items"),
    "collection": ("heading", "title", "kind", "limit", "pageSize", "showAllLink", "displayVariant"),
    "contacts": ("heading", "content"),
}
BARE = ("products", "services", "projects", "news")
_SPACE = re.compile(r"[ \t\n\r]*")
_DECODER = json.JSONDecoder()


def members(block: str) -> list[tuple[str, int, int, int]] | None:
    """(name, where the member begins, where its value begins and ends) of an object; None for anything else."""
    skip = lambda at: _SPACE.match(block, at).end()
    out: list[tuple[str, int, int, int]] = []
    try:
        at = skip(0)
        if block[at] != "{":
            return None
        at = skip(at + 1)
        while block[at] != "}":
            name, end = _DECODER.raw_decode(block, at)
            colon = skip(end)
            if not isinstance(name, str) or block[colon] != ":":
                return None
            low = skip(colon + 1)
            _, high = _DECODER.raw_decode(block, low)
            out.append((name, at, low, high))
            at = skip(high)
            if block[at] == ",":
                at = skip(at + 1)
                if block[at] == "}":
                    return None
            elif block[at] != "}":
                return None
        return out if skip(at + 1) == len(block) else None
    except (ValueError, IndexError, RecursionError):
        return None


def block_type(block: str, found: list[tuple[str, int, int, int]]) -> str:
    kinds = [json.loads(block[low:high]) for name, _, low, high in found if name == "type"]
    return str(kinds[-1]) if kinds and kinds[-1] else "unknown"


def shown(block: str) -> tuple[str, bool, list[tuple[str, str]]]:
    """Type, whether it has no editor, and the known fields with their JSON as it stands; of repeated names the last."""
    found = members(block)
    if found is None:
        return "unknown", True, []
    kind = block_type(block, found)
    known = FIELDS.get(kind.lower(), ())
    return kind, kind.lower() not in FIELDS and kind.lower() not in BARE, list({name: block[low:high] for name, _, low, high in found if name in known}.items())


def edited(block: str, edits: dict[str, str | None]) -> str:
    """The block with the JSON of some known fields replaced, added, or taken away (None)."""
    found = members(block)
    if found is None:
        return block
    known = FIELDS.get(block_type(block, found).lower(), ())
    valid = {}
    for name, value in edits.items():
        try:
            if value is not None:
                json.loads(value)
            if name in known:
                valid[name] = value
        except ValueError:
            continue
    head, close = block.index("{") + 1, block.rindex("}")
    pieces, kept = [], []
    for i, (name, begin, low, high) in enumerate(found):
        after = found[i + 1][1] if i + 1 < len(found) else close
        if name in valid and valid[name] is None:
            continue
        body = block[begin:low] + (block[low:high] if name not in valid else valid[name])
        comma = block.find(",", high, after) if i + 1 < len(found) else -1
        kept.append((body, block[high:comma] if comma >= 0 else "", block[comma:after] if comma >= 0 else ""))
    fresh = [(json.dumps(name, ensure_ascii=False) + ":" + value, "", "") for name, value in valid.items() if value is not None and name not in {f[0] for f in found}]
    everything = kept + fresh
    for i, (body, gap, comma) in enumerate(everything):
        pieces.append(body + (gap + (comma or ",") if i + 1 < len(everything) else ""))
    lead = block[head : found[0][1]] if found else ""
    tail = block[found[-1][3] : close] if found else block[head:close]
    return block[:head] + lead + "".join(pieces) + tail + block[close:]


_STATE = "type string, unsupported boolean, fields map<string,string>"


def _state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(None, None, None) if b is None else shown(b) for b in batch.column(1).to_pylist()]
        kinds, odd, fields = (pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()))))
        yield pa.RecordBatch.from_arrays([batch.column(0), kinds, odd, fields], names=["key", "type", "unsupported", "fields"])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [None if b is None else edited(b, dict(e or [])) for b, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "block"])


def editor_state(rows: DataFrame, key: str, block: str = "block") -> DataFrame:
    """``key``, type, unsupported, fields (name to JSON) of each block."""
    return rows.select(key, block).mapInArrow(_state, f"key {rows.schema[key].dataType.simpleString()}, {_STATE}").withColumnRenamed("key", key)


def apply_edits(rows: DataFrame, key: str, block: str = "block", edits: str = "edits") -> DataFrame:
    """``key`` and block after ``edits``, a map from field to JSON; a null value takes the field away."""
    return rows.select(key, block, edits).mapInArrow(_edit, f"key {rows.schema[key].dataType.simpleString()}, block string").withColumnRenamed("key", key)
