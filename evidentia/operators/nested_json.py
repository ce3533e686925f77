"""Deeply nested records to linked flat tables.

JSON texts are read by *structural indexing*: the texts of an Arrow batch are laid end to end in
byte buffers; bitmaps mark escapes, quotes, brackets and delimiters; a running parity over the
quotes masks what lies inside strings; a prefix sum over the brackets gives the nesting depth;
sorting the remaining marks by (text, depth, place) puts the marks of one container side by side,
so that the spans of its members fall out as the gaps between neighbours. Every emitted row keeps
its record's key, the places of the enclosing elements and its own place.

A buffer takes ``PORTION`` bytes of a batch, or one longer text. A bitmap is turned at once into the
places of its marks, so that the index holds some numbers for each mark and nothing for each byte.

Columns that are already typed (arrays and structs) are shredded by native higher-order
functions, never leaving the JVM.

Defined results: a null, blank or incomplete text has no children; a null element is no child but
keeps its place; a lone value or object where a list is usual is a list of one; a string that
itself holds JSON is read as that JSON, to any depth; an object that only wraps the list of
top-level elements is that list; a record without key is no record; a key delivered repeatedly is
one record; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import first_of_each, ship_package, spread

CHILD_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("child_table", T.StringType()),
            T.StructField("parent_pos", T.StringType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("value", T.StringType()),
        ]
    )
)
_CHILD_ARROW = pa.list_(
    pa.struct([("child_table", pa.string()), ("parent_pos", pa.string()), ("pos", pa.int32()), ("value", pa.string())])
)

#: Bytes of texts indexed together.
PORTION = 1 << 20
_MARKS, _BLANKS, _SIGNS = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, np.int8)
_MARKS[list(b"{}[],:")] = True
_BLANKS[list(b" \n\r\t")] = True
_SIGNS[list(b"{[")], _SIGNS[list(b"}]")] = 1, -1
_SCALAR = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")
_STRING = re.compile(rb'(?:[^\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+')


@dataclass(frozen=True)
class Child:
    """A child table: where its list lies in the parent element, and the tables below it."""

    table: str
    path: tuple[str, ...] = ()
    children: tuple["Child", ...] = field(default=())


class StructuralIndex:
    """Spans of all members of all containers of a batch of JSON texts.

    ``valid[t]`` tells whether text ``t`` is complete JSON. Members ("slots") are numbered so that
    those of one container are neighbours; the first ``len(texts)`` slots are the texts' roots.
    """

    def __init__(self, texts: Sequence[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        n = self.n_texts = len(raw)
        self.data = b"\n".join(raw) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        size = len(buf)
        number = self._number = np.int32 if size < 2**31 else np.int64
        sizes = np.fromiter(map(len, raw), np.int64, n)
        del raw
        self.ends = (np.cumsum(sizes + 1) - 1).astype(number)
        self.starts = (self.ends - sizes).astype(number)
        places = lambda bitmap: np.flatnonzero(bitmap).astype(number)

        # A quote is escaped after an odd run of backslashes; texts are parted by a line feed.
        back, quote = places(buf == 0x5C), places(buf == 0x22)
        if len(back):
            fresh = np.ones(len(back), bool)
            fresh[1:] = np.diff(back) != 1
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(back), dtype=number), 0))
            after = np.flatnonzero(buf[quote - 1] == 0x5C)
            at = np.searchsorted(back, quote[after]) - 1
            quote = np.delete(quote, after[(at - first[at]) % 2 == 0])
        before = lambda place: np.searchsorted(quote, place).astype(number)  # noqa: E731  # quotes before a place
        base = before(self.starts)

        mark = places(_MARKS[buf])
        text_of = lambda place: (np.searchsorted(self.starts, place, "right") - 1).astype(number)
        owner = text_of(mark)
        outside = (before(mark) - base[owner]) % 2 == 0
        mark, owner = mark[outside], owner[outside]

        # Depth by prefix sum, counted from each text's own start.
        sign = _SIGNS[buf[mark]]
        depth = np.cumsum(sign, dtype=number)
        begin, stop = np.searchsorted(mark, self.starts), np.searchsorted(mark, self.ends)
        depth -= np.concatenate((np.zeros(1, number), depth))[begin][owner]
        valid = (before(self.ends) - base) % 2 == 0
        marked = stop > begin
        if marked.any():
            valid[marked] &= (depth[stop[marked] - 1] == 0) & (np.minimum.reduceat(depth, begin[marked]) >= 0)
        self._find_blanks(buf)

        keep = valid[owner]
        mark, owner, sign = mark[keep], owner[keep], sign[keep]
        level = depth[keep] + (sign < 0)
        valid[owner[(level == 0) & (sign <= 0)]] = False
        keep = level > 0
        order = np.lexsort((level[keep], owner[keep]))  # places stay in order
        mark = mark[keep][order]
        del depth, level, owner, order, sign, keep
        is_open, is_close, is_colon = _SIGNS[buf[mark]] > 0, _SIGNS[buf[mark]] < 0, buf[mark] == 0x3A
        box = np.cumsum(is_open, dtype=number) - 1  # the container of each mark
        openers, closers = mark[is_open], mark[is_close]
        bad_pair = (buf[closers] - buf[openers]) != 2 if len(openers) == len(closers) else np.ones(len(openers), bool)
        valid[text_of(openers[bad_pair])] = False

        # Spans: the gaps between neighbouring marks of one container, colons aside.
        sep = places(~is_colon)
        gap = places(~is_close[sep[:-1]]) if len(sep) > 1 else np.zeros(0, number)
        s_box, s_from, s_to = box[sep[gap]], mark[sep[gap]] + 1, mark[sep[np.minimum(gap + 1, len(sep) - 1)]]
        alone = is_open[sep[gap]] & is_close[sep[np.minimum(gap + 1, len(sep) - 1)]]
        colon = places(is_colon)
        colon_slot = np.searchsorted(gap, np.searchsorted(sep, colon, "right") - 1, "right") - 1
        n_colon = np.bincount(colon_slot, minlength=len(gap)) if len(gap) else np.zeros(0, np.int64)
        colon_at = np.full(len(gap), -1, number)
        colon_at[colon_slot] = mark[colon]
        del box, sep, gap, colon, colon_slot, is_open, is_close, is_colon, mark
        in_object = buf[openers][s_box] == 0x7B
        v_from, v_to = self._next(np.where(colon_at >= 0, colon_at + 1, s_from)), self._prev(s_to)
        hollow = self._next(s_from) >= s_to
        wrong = (hollow & ~alone) | (~hollow & (n_colon != in_object)) | (~hollow & (v_from >= v_to))
        valid[text_of(openers[s_box[wrong]])] = False
        real = ~hollow & ~wrong
        s_box, colon_at, v_from, v_to, s_from = s_box[real], colon_at[real], v_from[real], v_to[real], s_from[real]

        # The texts' roots come first.
        r_from, r_to = np.minimum(self._next(self.starts), self.ends), self._prev(self.ends)
        valid &= r_from < r_to
        none = np.full(n, -1, number)
        self.v_from, self.v_to = np.concatenate((r_from, v_from)), np.concatenate((r_to, v_to))
        self.k_from = np.concatenate((none, np.where(colon_at >= 0, self._next(s_from), -1).astype(number)))
        self.k_to = np.concatenate((none, np.where(colon_at >= 0, self._prev(np.maximum(colon_at, 0)), -1).astype(number)))
        safe = np.minimum(self.v_from, size - 1)
        self.kind = buf[safe]
        self.box = np.full(len(safe), -1, number)
        composite = (self.kind == 0x7B) | (self.kind == 0x5B)
        by_place = np.argsort(openers, kind="stable")
        at = np.searchsorted(openers, safe[composite], sorter=by_place)
        held = by_place[np.minimum(at, max(len(openers) - 1, 0))] if len(openers) else np.zeros(0, np.int64)
        self.box[composite] = held if len(openers) else -1

        def reject(slots: np.ndarray) -> None:
            valid[text_of(safe[slots])] = False

        def standing(slots: np.ndarray) -> np.ndarray:
            return slots[valid[text_of(safe[slots])]]

        reject(np.flatnonzero(composite)[closers[held] != self.v_to[composite] - 1] if len(openers) else np.flatnonzero(composite))
        text = np.flatnonzero(self.kind == 0x22)
        t0, t1 = self.v_from[text], self.v_to[text]
        reject(text[(buf[np.maximum(t1 - 1, 0)] != 0x22) | (before(t1) - before(t0) != 2)])
        keyed = np.flatnonzero(self.k_from >= 0)
        k0, k1 = self.k_from[keyed], self.k_to[keyed]
        reject(keyed[(buf[k0] != 0x22) | (buf[np.maximum(k1 - 1, 0)] != 0x22) | (before(k1) - before(k0) != 2)])
        odd = places((buf == 0x5C) | (buf < 0x20))
        held_odd = lambda a, b: np.searchsorted(odd, b) > np.searchsorted(odd, a)
        for s in standing(text[held_odd(t0, t1)]):
            if not _STRING.fullmatch(self.data, self.v_from[s] + 1, self.v_to[s] - 1):
                reject(s)
        for s in standing(keyed[held_odd(k0, k1)]):
            if not _STRING.fullmatch(self.data, self.k_from[s] + 1, self.k_to[s] - 1):
                reject(s)
        for s in standing(np.flatnonzero(~composite & (self.kind != 0x22))):
            if not _SCALAR.fullmatch(self.data, self.v_from[s], self.v_to[s]):
                reject(s)
        containers = np.arange(len(openers))
        self.first = (n + np.searchsorted(s_box, containers)).astype(number)
        self.after = (n + np.searchsorted(s_box, containers, "right")).astype(number)
        self.valid = valid
        del self._runs, self._run_ends

    def _find_blanks(self, buf: np.ndarray) -> None:
        """Starts and ends of the runs of blanks."""
        blank = _BLANKS[buf]
        edges = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(0), append=np.int8(0))).astype(self._number)
        self._runs, self._run_ends = edges[::2], edges[1::2]

    def _next(self, place: np.ndarray) -> np.ndarray:
        """The first place from here on that is not blank."""
        k = np.searchsorted(self._runs, place, "right") - 1  # the buffer ends in a blank, so there is a run
        end = self._run_ends[np.maximum(k, 0)]
        return np.where((k >= 0) & (place < end), end, place)

    def _prev(self, place: np.ndarray) -> np.ndarray:
        """The place after the last one before here that is not blank."""
        k = np.searchsorted(self._runs, place, "left") - 1
        return np.where((k >= 0) & (place <= self._run_ends[np.maximum(k, 0)]), self._runs[np.maximum(k, 0)], place)

    def members(self, slot: int) -> range:
        b = self.box[slot]
        return range(self.first[b], self.after[b])

    def raw(self, slot: int) -> bytes:
        return self.data[self.v_from[slot] : self.v_to[slot]]

    def get(self, slot: int, key: str) -> int:
        """The member of an object with this key (the last one, as usual), else -1."""
        want, found = json.dumps(key, ensure_ascii=False).encode(), -1
        for m in self.members(slot):
            if self.data[self.k_from[m] : self.k_to[m]] == want:
                found = m
        return found

    def strings_with_json(self) -> list[int]:
        """String slots of valid texts whose content begins as JSON containers or strings do."""
        out = []
        head = np.frombuffer(self.data, np.uint8)[np.minimum(self.v_from + 1, len(self.data) - 1)]
        likely = (self.kind == 0x22) & np.isin(head, np.frombuffer(b'[{\\ \t', np.uint8))
        for s in np.flatnonzero(likely):
            text = self.text(s)
            if text.lstrip()[:1] in ("[", "{", '"'):
                out.append(int(s))
        return out

    def text(self, slot: int) -> str:
        try:
            return json.loads(self.raw(slot))
        except ValueError:
            return ""


class _Batch:
    """Indexes a batch and, round by round, the JSON held in its strings."""

    def __init__(self, texts: Sequence[str | None]):
        self.rounds = [StructuralIndex(texts)]
        self.inner: dict[tuple[int, int], int] = {}
        while True:
            k = len(self.rounds) - 1
            slots = self.rounds[k].strings_with_json()
            if not slots:
                break
            for t, s in enumerate(slots):
                self.inner[k, s] = t
            self.rounds.append(StructuralIndex([self.rounds[k].text(s) for s in slots]))

    def resolve(self, k: int, slot: int) -> tuple[int, int] | None:
        """The value itself, or the JSON that the string holds; None for a string of broken JSON."""
        while (k, slot) in self.inner:
            slot = self.inner[k, slot]
            k += 1
            if not self.rounds[k].valid[slot]:
                return None
        return k, slot

    def elements(self, at: tuple[int, int] | None, top: bool, reserved: frozenset[str]) -> Iterator[tuple[int, int, int]]:
        if at is None or (at := self.resolve(*at)) is None:
            return
        k, slot = at
        ix = self.rounds[k]
        kind = ix.kind[slot]
        if kind == 0x7B and top and len(ix.members(slot)) == 1:  # an object that only wraps the list
            (m,) = ix.members(slot)
            key = json.loads(ix.data[ix.k_from[m] : ix.k_to[m]])
            held = self.resolve(k, m)
            if key not in reserved and held is not None and self.rounds[held[0]].kind[held[1]] == 0x5B:
                k, slot = held
                ix, kind = self.rounds[k], 0x5B
        if kind == 0x5B:
            for pos, m in enumerate(ix.members(slot)):
                if ix.raw(m) != b"null":
                    yield pos, k, m
        elif kind == 0x22:
            if not top and ix.text(slot).strip():
                yield 0, k, slot
        elif ix.raw(slot) != b"null":
            yield 0, k, slot

    def follow(self, k: int, slot: int, path: tuple[str, ...]) -> tuple[int, int] | None:
        at: tuple[int, int] | None = (k, slot)
        for key in path:
            if at is None or (at := self.resolve(*at)) is None:
                return None
            ix = self.rounds[at[0]]
            if ix.kind[at[1]] != 0x7B or (m := ix.get(at[1], key)) < 0:
                return None
            at = at[0], m
        return at


def shred_texts(texts: Sequence[str | None], spec: Child, with_values: bool = True) -> list[list[tuple]]:
    """(table, parent_pos, pos, value) of every child in each text, in document order by table."""
    batch = _Batch(texts)
    reserved = frozenset(c.path[0] for c in spec.children if c.path)
    out: list[list[tuple]] = []

    def emit(rows: list[tuple], child: Child, at: tuple[int, int] | None, parents: str, top: bool) -> None:
        for pos, k, m in batch.elements(at, top, reserved):
            value = batch.rounds[k].raw(m).decode("utf-8", "replace") if with_values else None
            rows.append((child.table, parents, pos, value))
            here = f"{parents}/{pos}" if parents else str(pos)
            for c in child.children:
                emit(rows, c, batch.follow(k, m, c.path), here, False)

    for t in range(len(texts)):
        rows: list[tuple] = []
        if batch.rounds[0].valid[t]:
            emit(rows, spec, (0, t), "", True)
        out.append(rows)
    return out


def portions(sizes: Sequence[int], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``most`` bytes together, or of one longer text."""
    most = PORTION if most is None else most
    begin = held = 0
    for i, size in enumerate(sizes):
        if held + size > most and i > begin:
            yield begin, i
            begin, held = i, 0
        held += size
    if len(sizes) > begin:
        yield begin, len(sizes)


def shred_array(texts: pa.Array, spec: Child, with_values: bool = True) -> pa.Array:
    """The child rows of each text of an Arrow array, indexed portion by portion."""
    out = []
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for a, b in portions(sizes):
        rows = shred_texts(texts.slice(a, b - a).to_pylist(), spec, with_values)
        flat = [r for record in rows for r in record]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32), pa.int32())
        table, parent, pos, value = zip(*flat, strict=True) if flat else ((), (), (), ())
        items = pa.StructArray.from_arrays(
            [pa.array(table, pa.string()), pa.array(parent, pa.string()), pa.array(pos, pa.int32()), pa.array(value, pa.string())],
            fields=list(_CHILD_ARROW.value_type),
        )
        out.append(pa.ListArray.from_arrays(offsets, items, type=_CHILD_ARROW))
    return pa.concat_arrays(out) if out else pa.array([], _CHILD_ARROW)


def shred_udf(spec: Child, with_values: bool = True):
    """Arrow UDF: a column of JSON texts to an array of child rows."""

    @F.arrow_udf(CHILD_TYPE)
    def shred(texts: pa.Array) -> pa.Array:
        return shred_array(texts, spec, with_values)

    return shred


def _row(table: str, parent: Column, pos: Column, value: Column, with_values: bool) -> Column:
    text = value.cast("string") if with_values else F.lit(None).cast("string")
    fields = F.struct(F.lit(table).alias("child_table"), parent.alias("parent_pos"), pos.cast("int").alias("pos"), text.alias("value"))
    return F.when(value.isNotNull(), fields)


def list_children(table: str, items: Column, with_values: bool = False, as_text=lambda x: x) -> Column:
    """Child rows of a typed top-level array."""
    return F.transform(items, lambda x, i: _row(table, F.lit(""), i, as_text(x), with_values))


def nested_children(table: str, items: Column, inner, with_values: bool = False) -> Column:
    """Child rows of an array inside the elements of a typed array."""
    return F.flatten(
        F.transform(
            items,
            lambda x, i: F.coalesce(
                F.transform(inner(x), lambda y, j: _row(table, i.cast("string"), j, y, with_values)),
                F.array().cast(CHILD_TYPE),
            ),
        )
    )


def related_tables(df: DataFrame, key: str, parts: list[Column]) -> DataFrame:
    """All child rows of every record: ``key, child_table, parent_pos, pos, value``."""
    none = F.array().cast(CHILD_TYPE)
    rows = df.select(
        F.col(key), F.filter(F.concat(*[F.coalesce(p.cast(CHILD_TYPE), none) for p in parts]), lambda x: x.isNotNull()).alias("_rows")
    )
    return first_of_each(rows, key).select(key, F.inline("_rows"))


#: The child tables of a planning trace.
PLANNING = Child(
    "planning_trace",
    (),
    (
        Child("planning_trace.nodes", ("nodes",), (Child("planning_trace.nodes.depends_on", ("depends_on",)),)),
        Child("planning_trace.hits", ("hits",)),
        Child("planning_trace.claim_supports", ("telemetry_snapshot", "claim_supports")),
    ),
)


def trajectory_tables(trajectories: DataFrame, with_values: bool = True) -> DataFrame:
    """Policy events, planning events and support scores of trajectories as linked child rows."""
    ship_package(trajectories.sparkSession)
    df = spread(trajectories.select("result_id", "policy_trace", "planning_trace", "support"))
    as_json = (lambda x: F.when(x.isNotNull(), F.to_json(x))) if with_values else (lambda x: x.isNotNull())
    present = (lambda x: as_json(x)) if with_values else (lambda x: F.when(x.isNotNull(), F.lit(True)))
    snapshot = "telemetry_snapshot"
    return related_tables(
        df,
        "result_id",
        [
            list_children("policy_trace", F.col("policy_trace"), with_values, present),
            nested_children("policy_trace.claim_supports", F.col("policy_trace"), lambda e: e["details"][snapshot]["claim_supports"], with_values),
            shred_udf(PLANNING, with_values)(F.col("planning_trace")),
            list_children("support.claim_supports", F.col("support.claim_supports"), with_values),
            nested_children("support.passage_support_matrix", F.col("support.passage_support_matrix"), lambda r: r, with_values),
        ],
    )
