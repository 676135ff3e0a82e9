"""Deeply nested semi-structured records to related flat tables (p1).

Records stay bytes: the text buffer of an Arrow batch is indexed once, with all of its rows, by the places of quotes, brackets,
commas and colons outside strings. Brackets give every container its level and its parent, children of a level form one list array
given by offsets, and the parent-index kernel with vectorised ``take`` carries record keys, paths and parent links down level by level.
Values are slices of the buffer. No row is walked, no value is visited one by one, no schema is inferred and no depth is too deep;
the JSON scanner only tells whether a field is valid.

``flatten`` gives one table of all objects, ``related_tables`` one typed table for each kind of object, linked by record and path.

Results for awkward input: a null or undecodable field gives no rows (``NaN`` and ``Infinity`` are not JSON); a field that
is a JSON string holding JSON text is decoded again; repeated records give rows each, told apart by their id; of a repeated
key the last value counts; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage

OBJECTS = "field string, node_path string, parent_path string, table_path string, position int, attributes map<string,string>"
#: Columns that the related tables of a data set may have together; their names are collected.
MOST_COLUMNS = 20_000
ROWS = 2000  # texts that are indexed together


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)
_PIECE = re.compile(
    r'[ \t\n\r]*(?:(?P<open>[\[{])|(?P<close>[\]}])|(?P<comma>,)|(?P<colon>:)|(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")'
    r"|(?P<other>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))"
)


def well_formed(text: str) -> bool:
    """Whether a text is JSON, with a stack of its own: for texts nested deeper than the scanner can recurse."""
    stack, want, at, end = [], "value", 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _PIECE.match(text, at)
        if not m:
            return False
        at, kind = m.end(), m.lastgroup
        if want in ("value", "value or end") and kind == "open":
            stack.append(m["open"])
            want = "value or end" if m["open"] == "[" else "key or end"
        elif kind == "close":
            if not stack or (stack.pop() == "[") != (m["close"] == "]") or want not in ("next", "value or end" if m["close"] == "]" else "key or end"):
                return False
            want = "next"
        elif want in ("value", "value or end") and kind in ("text", "other"):
            want = "next"
        elif want in ("key", "key or end") and kind == "text":
            want = "colon"
        elif want == "colon" and kind == "colon":
            want = "value"
        elif want == "next" and kind == "comma" and stack:
            want = "value" if stack[-1] == "[" else "key"
        else:
            return False
    return want == "next" and not stack


def unwrapped(text: str | None) -> str | None:
    """The JSON text of a field, taken out of a JSON string if it is one as a whole; None where it isn't valid."""
    while text is not None:
        try:
            value = _DECODER.decode(text)
        except ValueError:
            return None
        except RecursionError:  # a container: strings don't nest
            return text if well_formed(text) else None
        if not isinstance(value, str):
            return text
        text = value
    return None


def decode(text: str | None):
    """(value, whether it is valid JSON); JSON text inside a JSON string is decoded as well. Texts too deep for objects of the interpreter have no value."""
    plain = unwrapped(text)
    try:
        return (None, False) if plain is None else (_DECODER.decode(plain), True)
    except RecursionError:
        return None, True


class Containers(NamedTuple):
    """Objects and arrays of a batch of texts in order of place, and what is needed to cut values out of the buffer."""

    row: np.ndarray  # text that holds it
    level: np.ndarray  # 1 for the outermost
    parent: np.ndarray  # container around it, -1 for none
    is_object: np.ndarray
    position: np.ndarray  # in the array around it, -1 for members of objects
    key: pa.Array  # of the member it is, "" for array elements
    live: np.ndarray  # False where a later member has the same key


class Scalars(NamedTuple):
    """Values that are no containers."""

    container: np.ndarray
    position: np.ndarray
    key: pa.Array
    value: pa.Array  # strings without quotes, other values as written, null for null
    quoted: np.ndarray  # whether it is a string


def by_levels(level: np.ndarray) -> list[np.ndarray]:
    """Containers of each level, in order of place."""
    order = np.argsort(level, kind="stable")
    return np.split(order, np.searchsorted(level[order], np.arange(2, int(level.max(initial=0)) + 1))) if len(level) else []


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """Slices of the buffer as one string array."""
    sizes = end - start
    ends = np.cumsum(sizes)
    gathered = data[np.repeat(start - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(gathered.tobytes()))


def _unescaped(texts: pa.StringArray, escaped: np.ndarray) -> pa.Array:
    """Strings with their escapes resolved; few have any."""
    if not escaped.any():
        return texts
    fixed = [json.loads(f'"{t}"', strict=False).encode("utf-8", "replace").decode() for t in texts.filter(pa.array(escaped)).to_pylist()]
    return pc.replace_with_mask(texts, pa.array(escaped), pa.array(fixed, pa.string()))


def index(texts: pa.StringArray, scalars: bool) -> tuple[Containers, Scalars | None]:
    """Containers and, where asked for, scalars of valid JSON texts."""
    data, starts = _bytes(texts)
    slash = np.flatnonzero(data == ord("\\"))
    quote = np.flatnonzero(data == ord('"'))
    if len(slash):
        # a quote behind an odd run of backslashes is escaped; runs end where the next place isn't one more
        run_end = np.flatnonzero(np.diff(slash, append=-2) != 1)
        run_size = np.diff(run_end, prepend=-1)
        quote = quote[~np.isin(quote, slash[run_end[run_size % 2 == 1]] + 1)]
    place = np.flatnonzero(np.isin(data, np.frombuffer(b"[]{},:", np.uint8)))
    place = place[np.searchsorted(quote, place) % 2 == 0]  # outside strings
    code = data[place]
    opens_here, closes_here = (code == ord("[")) | (code == ord("{")), (code == ord("]")) | (code == ord("}"))
    depth = np.cumsum(opens_here.astype(np.int64) - closes_here)
    token = np.arange(len(place))
    opened = np.flatnonzero(opens_here)
    level, is_object = depth[opened], code[opened] == ord("{")
    wide = len(place) + 1
    by_level = np.argsort(level * wide + opened, kind="stable")
    sorted_key = (level * wide + opened)[by_level]

    def around(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """The container of a level that was opened last before each token."""
        found = np.searchsorted(sorted_key, levels * wide + tokens) - 1
        return np.where(levels > 0, by_level[np.maximum(found, 0)] if len(by_level) else -1, -1)

    parent = around(opened, level - 1)
    comma = np.flatnonzero(code == ord(","))
    comma_in = around(comma, depth[comma])
    comma_key = np.sort(comma_in * wide + comma)

    def position_in(container: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Commas of a container before each token."""
        return np.searchsorted(comma_key, container * wide + tokens) - np.searchsorted(comma_key, container * wide)

    def keys_before(colons: np.ndarray) -> pa.Array:
        """The string that ends before each colon."""
        close = np.searchsorted(quote, place[colons]) - 1
        start, end = quote[close - 1] + 1, quote[close]
        return _unescaped(_slices(data, start, end), np.searchsorted(slash, end) > np.searchsorted(slash, start))

    inside = parent >= 0
    member = inside & np.where(inside, is_object[np.maximum(parent, 0)] if len(is_object) else False, False)
    element = inside & ~member
    colon = opened - 1
    key = _spread(keys_before(colon[member]), member)
    position = np.where(element, position_in(np.maximum(parent, 0), opened), -1)
    row = np.searchsorted(starts, place[opened], side="right") - 1

    # members of one object with equal keys: the last one counts
    colons = np.flatnonzero(code == ord(":"))
    names = pc.dictionary_encode(keys_before(colons)).indices.to_numpy().astype(np.int64)
    names_wide = int(names.max(initial=0)) + 1
    pair = around(colons, depth[colons]) * names_wide + names
    last = np.zeros(len(colons), dtype=bool)
    _, at = np.unique(pair[::-1], return_index=True)
    last[len(pair) - 1 - at] = True
    live = np.ones(len(opened), dtype=bool)
    if not last.all():
        live[member] = last[np.searchsorted(colons, colon[member])]
        for at in by_levels(level)[1:]:
            live[at] &= live[parent[at]]
    found = Containers(row, level, parent, is_object, position, key, live)
    if not scalars:
        return found, None

    # a value stands behind a colon, or behind a bracket or comma of an array; it is no container if the next token ends it
    container = np.full(len(place), -1)
    container[opened], container[comma], container[colons] = np.arange(len(opened)), comma_in, around(colons, depth[colons])
    holds = (code == ord(":")) | (((code == ord(",")) | (code == ord("["))) & ~np.append(is_object, False)[container])
    ends_next = np.append(closes_here[1:] | (code[1:] == ord(",")), False)
    slot = np.flatnonzero(holds & ends_next)
    blank = np.isin(data, np.frombuffer(b" \t\n\r", np.uint8))
    solid = np.flatnonzero(~blank)
    start = solid[np.searchsorted(solid, place[slot] + 1)] if len(slot) else slot
    end = solid[np.searchsorted(solid, place[slot + 1]) - 1] + 1 if len(slot) else slot
    real = start < end  # not an empty array
    kept = np.ones(len(place), dtype=bool)
    kept[colons] = last
    real &= kept[slot] & live[container[slot]]
    slot, start, end = slot[real], start[real], end[real]
    named = code[slot] == ord(":")
    quoted = data[start] == ord('"') if len(slot) else np.zeros(0, bool)
    escaped = np.searchsorted(slash, end) > np.searchsorted(slash, start)
    value = _unescaped(_slices(data, start + quoted, end - quoted), escaped & quoted)
    null = ~quoted & (data[start] == ord("n")) if len(slot) else np.zeros(0, bool)
    value = pc.if_else(pa.array(null), pa.scalar(None, pa.string()), value)
    at = np.where(named, -1, position_in(container[slot], slot) + (code[slot] == ord(",")))
    return found, Scalars(container[slot], at, _spread(keys_before(slot[named]), named), value, quoted)


def _spread(values: pa.Array, mask: np.ndarray) -> pa.Array:
    """The values at the places of the mask, "" elsewhere."""
    places = np.where(mask, np.cumsum(mask) - 1, len(values))
    return pc.take(pa.concat_arrays([pc.cast(values, pa.string()), pa.array([""], pa.string())]), pa.array(places))


def _step(position: pa.Array, key: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(whether elements of arrays, their index in brackets, and the step to be appended to a path)."""
    element = pc.greater_equal(position, 0)
    bracket = pc.binary_join_element_wise("[", pc.cast(position, pa.string()), "]", "")
    return element, bracket, pc.if_else(element, bracket, pc.binary_join_element_wise("", key, "."))


def flatten_batch(ids: pa.Array, field: str, texts: list, attributes: bool, roots: bool) -> Iterator[pa.RecordBatch]:
    """Object tables of one field of a batch, one record batch for each level."""
    plain = [unwrapped(t) for t in texts]
    valid = np.flatnonzero([t is not None for t in plain])
    if not len(valid):
        return
    nodes, scalars = index(pa.array([plain[i] for i in valid], pa.string()), attributes)
    n, total = len(valid), len(nodes.row)
    slot_of = np.zeros(total, dtype=np.int64)  # where the attributes of a container are gathered: the texts come first, then objects in arrays
    prefixes: list[pa.Array] = []  # keys below that object, by level
    emitted, slots = [], n
    if roots:
        emitted.append((np.arange(n), pa.array([field] * n, pa.string()), pa.nulls(n, pa.string()), pa.array([field] * n, pa.string()), np.zeros(n, np.int32), np.arange(n)))
    # level 0 is the field itself
    path = generic = owner = pa.array([field] * n, pa.string())
    prefix = pa.array([""] * n, pa.string())
    slot, above = np.arange(n), np.arange(n)
    levels = [at[nodes.live[at]] for at in by_levels(nodes.level)]
    for level, here in enumerate(levels, 1):
        # children of the level above as one list array; the kernel gives the parent of each
        inside = nodes.row[here] if level == 1 else np.searchsorted(above, nodes.parent[here])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(inside, np.arange(len(above) + 1)).astype(np.int32)), pa.array(here))
        parent = pc.list_parent_indices(lists)
        path, generic, owner, prefix = (pc.take(x, parent) for x in (path, generic, owner, prefix))
        slot = slot[parent.to_numpy()]
        if level > 1:
            position, key = pa.array(nodes.position[here]), pc.take(nodes.key, pa.array(here))
            element, bracket, step = _step(position, key)
            path = pc.binary_join_element_wise(path, step, "")
            generic = pc.binary_join_element_wise(generic, pc.if_else(element, "[]", step), "")
            is_node = nodes.is_object[here] & (nodes.position[here] >= 0)
            at = np.flatnonzero(is_node)
            fresh = np.arange(slots, slots + len(at))
            slots += len(at)
            taken = pa.array(at)
            emitted.append((nodes.row[here][at], pc.take(path, taken), pc.take(owner, taken), pc.take(generic, taken), nodes.position[here][at].astype(np.int32), fresh))
            owner = pc.if_else(pa.array(is_node), path, owner)
            if attributes:
                slot[at] = fresh
                below = pc.if_else(element, bracket, key)
                longer = pc.if_else(pc.equal(prefix, ""), below, pc.binary_join_element_wise(prefix, below, "."))
                prefix = pc.if_else(pa.array(is_node), "", longer)
        slot_of[here] = slot
        prefixes.append(prefix)
        above = here
    maps = _maps(levels, scalars, slot_of, prefixes, slots) if attributes and scalars is not None else None
    record = pa.array(valid)
    for row, node_path, parent_path, table_path, position, at in emitted:
        if len(row):
            held = pc.take(maps, pa.array(at)) if maps is not None else pa.nulls(len(row), pa.map_(pa.string(), pa.string()))
            columns = [pc.take(ids, pc.take(record, pa.array(row))), pa.array([field] * len(row), pa.string()), node_path, parent_path, table_path, pa.array(position, pa.int32()), held]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *[c.split(" ")[0] for c in OBJECTS.split(", ")]])


def _maps(levels: list[np.ndarray], scalars: Scalars, slot_of: np.ndarray, prefixes: list[pa.Array], slots: int) -> pa.Array:
    """The scalars of each slot as a map from the keys below its object."""
    order = np.concatenate([*levels, np.zeros(0, np.int64)]).astype(np.int64)
    place = np.zeros(len(slot_of), dtype=np.int64)
    place[order] = np.arange(len(order))
    prefix = pc.take(pa.concat_arrays(prefixes) if prefixes else pa.array([], pa.string()), pa.array(place[scalars.container]))
    element, bracket, _ = _step(pa.array(scalars.position), scalars.key)
    below = pc.if_else(element, bracket, scalars.key)
    name = pc.if_else(pc.equal(prefix, ""), below, pc.binary_join_element_wise(prefix, below, "."))
    slot = slot_of[scalars.container]
    # a dotted key may spell the same name as nested ones: the last counts
    names = pc.dictionary_encode(name).indices.to_numpy().astype(np.int64)
    pair = slot * (int(names.max(initial=0)) + 1) + names
    _, at = np.unique(pair[::-1], return_index=True)
    kept = np.sort(len(pair) - 1 - at)
    kept = kept[np.argsort(slot[kept], kind="stable")]
    offsets = np.searchsorted(slot[kept], np.arange(slots + 1)).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(offsets), pc.take(name, pa.array(kept)), pc.take(scalars.value, pa.array(kept)))


def flatten(df: DataFrame, id_col: str, fields: tuple[str, ...], attributes: bool = True, roots: bool = False) -> DataFrame:
    """(id, field, node_path, parent_path, table_path, position, attributes): one row for each object that is an array element.

    ``table_path`` names the child table (positions left out), ``position`` the place in the array, ``attributes`` the scalar
    values below the object down to the next such object. With ``roots`` each valid field also gives a row of its own, whose
    parent is null.
    """
    narrow = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                for i, field in enumerate(fields):
                    yield from flatten_batch(part.column(0), field, part.column(i + 1).to_pylist(), attributes, roots)

    kind = dict(df.dtypes)[id_col]
    return narrow.mapInArrow(run, f"id {kind}, {OBJECTS}").withColumnRenamed("id", id_col)


def related_tables(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> dict[str, DataFrame]:
    """One table for each kind of object, by table_path: (id, node_path, parent_path, position, a typed column for each attribute).

    A column is bigint, double or boolean if all its values read so, else string; columns of no value at all are strings. Attributes that
    share a name with a link column get ``_value`` appended. Rows of one table link to those of the enclosing one by record and parent_path.
    """
    flat = cut_lineage(flatten(df, id_col, fields, roots=True))
    cell = flat.select("table_path", F.explode("attributes").alias("key", "v"))
    kinds = {"bigint": F.col("v").try_cast("bigint").isNotNull() & F.col("v").rlike(r"^-?(0|[1-9]\d*)$"), "double": F.col("v").try_cast("double").isNotNull() & F.col("v").rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), "boolean": F.col("v").isin("true", "false")}
    told = cell.groupBy("table_path", "key").agg(F.count("v").alias("n"), *[F.count_if(c).alias(k) for k, c in kinds.items()]).limit(MOST_COLUMNS + 1).collect()
    if len(told) > MOST_COLUMNS:
        raise ValueError(f"related tables have at most {MOST_COLUMNS} columns together")
    tables = {r.table_path for r in flat.select("table_path").distinct().limit(MOST_COLUMNS).collect()}
    links = ["node_path", "parent_path", "position"]
    out = {}
    for table in sorted(tables):
        columns = []
        for r in sorted((r for r in told if r.table_path == table), key=lambda r: r.key):
            kind = next((k for k in kinds if r.n and r[k] == r.n), "string")
            name = f"{r.key}_value" if r.key in (id_col, *links) else r.key
            columns.append(F.try_element_at("attributes", F.lit(r.key)).try_cast(kind).alias(name))
        out[table] = flat.where(F.col("table_path") == table).select(id_col, *links, *columns)
    return out
