"""Records of JSON and HTML documents of any size, read in blocks by a parallel lexer.

A document is cut into blocks of lines, and a long line into several blocks, wherever that falls. What a block
does to the reader depends on where it begins: inside a string, so many brackets deep, half-way through a tag.
So each block is first summed up for every state it may begin in; the sums, one row a block, are
folded in the order of the document and give every block its true state; then all blocks cut their records on
their own. A record that crosses blocks is put together from its parts. No row holds a document.

JSON has two kinds of records: elements of an array (``[record, ...]``) and tabs of a backup
(``{"export": [{"tabs": [record, ...]}, ...]}``). The text around records is cut into pieces as well, and every piece
is checked by Spark's own parser, so a document counts as valid where a parser of the whole would say so.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefmill.functions.text import is_blank
from hrefmill.storage import cut_lineage

# Executors need not have this package installed: its task code travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 18
#: States of blocks that are broadcast back to their texts, some 200 bytes each; more are joined.
BROADCAST_BLOCKS = 100_000
_PLACE = ["filename", "first", "part"]


# --- blocks and states ----------------------------------------------------------------------------


def text_blocks(lines: DataFrame, size: int = BLOCK, joiner: str = "\n") -> DataFrame:
    """``(filename, first, part, text)``: runs of neighbouring lines of about ``size`` characters, written once.

    Neighbours in the input end up in one block; lines in any other order make more blocks, nothing worse.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def sent() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.string()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [*_PLACE, "text"])

        open_: list[str] = []
        name, first, last, length = None, 0, 0, 0
        for batch in batches:
            for filename, pos, line in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if open_ and (filename != name or pos != last + 1 or length + len(line) >= size):
                    rows.append((name, first, 0, "".join(open_)))
                    held += length
                    open_ = []
                if not open_:
                    name, first, length = filename, pos, 0
                last = pos
                text = line + joiner
                if len(text) > size and not open_:
                    rows.extend((name, pos, k, text[at : at + size]) for k, at in enumerate(range(0, len(text), size)))
                    held += len(text)
                else:
                    open_.append(text)
                    length += len(text)
                if held > 4 * BLOCK:
                    held = 0
                    yield sent()
        if open_:
            rows.append((name, first, 0, "".join(open_)))
        if rows:
            yield sent()

    cut = lines.select("filename", F.col("pos").cast("bigint"), "line")
    return cut_lineage(cut.mapInArrow(run, "filename string, first long, part int, text string"))


def folded(sums: DataFrame, start: Callable, step: Callable, schema: str, ends: bool = False) -> DataFrame:
    """State at which each block begins, as columns of ``schema`` after the block's place.

    ``step(state, row)`` is the state after a block. The sums of a file pass through one task in their order,
    which holds one state; with ``ends`` a row of part -1 tells the state after the last block.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip([*_PLACE, *names], r)) for r in rows], made)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row["filename"] != name:
                    if ends and state is not None:
                        out.append((name, None, -1, *state.row()))
                    name, state = row["filename"], start()
                out.append((name, row["first"], row["part"], *state.row()))
                state = step(state, row)
            yield batch_of(out)
        if ends and state is not None:
            yield batch_of([(name, None, -1, *state.row())])

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    made = pa.schema(
        [("filename", pa.string()), ("first", pa.int64()), ("part", pa.int32())]
        + [(n, kinds[p.split()[1]]) for n, p in zip(names, schema.split(", "))]
    )
    ordered = sums.repartition("filename").sortWithinPartitions(*_PLACE)
    return cut_lineage(ordered.mapInArrow(run, f"filename string, first long, part int, {schema}"))


def _entered(blocks: DataFrame, states: DataFrame) -> DataFrame:
    """Blocks with the state they begin in; texts are not shuffled unless the states are too many to send."""
    if states.count() <= BROADCAST_BLOCKS:
        states = F.broadcast(states)
    return blocks.join(states, _PLACE)


def _task(make: Callable[[dict], Iterator[tuple]], schema: pa.Schema) -> Callable:
    """A task that makes rows of ``schema`` from each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                rows.extend(make(batch.slice(k, 1).to_pylist()[0]))
                if rows and (len(rows) >= 4096 or k + 1 == batch.num_rows):
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    rows = []

    return run


# --- JSON: strings and depth ----------------------------------------------------------------------

_STRUCTURE = np.zeros(256, bool)
_STRUCTURE[list(b"[]{},:")] = True
_STEP = np.zeros(256, "i8")
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1


def lex(data: np.ndarray, in_string: int, escaped: int) -> tuple[np.ndarray, int, int]:
    """Places of the structural bytes outside strings, and the state after the last byte.

    ``escaped`` says that the first byte follows a backslash that escapes it. Quotes behind an odd run of
    backslashes do not count; outside strings a backslash is an error that the pieces' parser reports.
    """
    n = len(data)
    if not n:
        return np.zeros(0, "i8"), in_string, escaped
    quote, slash = data == 0x22, data == 0x5C
    after = 0
    if escaped or slash.any():
        at = np.arange(n)
        last = np.maximum.accumulate(np.where(slash, -1, at))
        run = at - last + np.where(last < 0, escaped, 0)  # backslashes up to here
        run[~slash] = 0
        before = np.concatenate([[escaped], run[:-1]])
        quote &= before % 2 == 0
        after = int(run[-1] % 2)
    inside = (np.cumsum(quote) + in_string) % 2
    return np.flatnonzero(_STRUCTURE[data] & (inside == 0)), int(inside[-1]), after


def _first_bracket(found: np.ndarray) -> str:
    opened = found[_STEP[found] > 0][:1]
    return chr(opened[0]) if len(opened) else ""


@dataclass
class _Depth:
    in_string: int = 0
    escaped: int = 0
    depth: int = 0
    root: str = ""

    def row(self) -> tuple:
        return self.in_string, self.escaped, self.depth, self.root


def _depth_sums(row: dict) -> Iterator[tuple]:
    data = np.frombuffer(row["text"].encode(), "u1")
    exits, nets, roots = [], [], []
    for state in range(4):
        places, in_string, escaped = lex(data, state % 2, state // 2)
        found = data[places]
        exits.append(in_string + 2 * escaped)
        nets.append(int(_STEP[found].sum()))
        roots.append(_first_bracket(found))
    yield row["filename"], row["first"], row["part"], exits, nets, roots


_DEPTH_SUMS = pa.schema(
    [("filename", pa.string()), ("first", pa.int64()), ("part", pa.int32()), ("exits", pa.list_(pa.int32())),
     ("nets", pa.list_(pa.int64())), ("roots", pa.list_(pa.string()))]
)


def _depth_step(state: _Depth, row: dict) -> _Depth:
    at = state.in_string + 2 * state.escaped
    exit_ = row["exits"][at]
    return _Depth(exit_ % 2, exit_ // 2, state.depth + row["nets"][at], state.root or row["roots"][at])


# --- JSON: the path to the records ------------------------------------------------------------------

_SPACE = " \t\r\n"
_KEY = 64  # characters of a key that are looked at; the two that matter are shorter, even with escapes


def _key_of(text: str) -> str | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, str) else None


@dataclass
class Path:
    """Where a reader is on the way to the records: open containers on that way, each with the number of the
    current member, its key, and whether its value is still to come (0), due (1) or read (2)."""

    root: str
    on: int = 0
    index: list | None = None
    phase: list | None = None
    key: list | None = None
    tabs: bool = False
    exported: int = -1
    bad: bool = False
    text: str = ""

    def __post_init__(self):
        self.index = self.index or [0] * 5
        self.phase = self.phase or [0] * 5
        self.key = self.key or [None] * 5

    def row(self) -> tuple:
        return json.dumps([self.on, self.index, self.phase, self.key, self.tabs, self.exported, self.bad, self.text]), self.exported, (
            not self.bad and self.on == 0 and self.phase[0] == 2
        )

    @staticmethod
    def read(root: str, stored: str) -> Path:
        return Path(root, *json.loads(stored))

    @property
    def deepest(self) -> int:
        return 1 if self.root == "[" else 4

    def kind(self, level: int) -> str:
        return self.root if level == 1 else "[" if level in (2, 4) else "{"

    def extends(self, char: str) -> bool:
        """Whether an opening bracket, with nothing before it, leads on to the records."""
        on = self.on
        if on == self.deepest or char != self.kind(on + 1):
            return False
        wanted = {0: 0, 1: 1, 2: 0, 3: 1}[on]
        name = {1: "export", 3: "tabs"}.get(on)
        return self.phase[on] == wanted and (name is None or self.key[on] == name)

    def cuts(self, char: str, level: int, blank: bool) -> bool:
        if char in "[{":
            return level == self.on + 1 and blank and self.extends(char)
        return level == self.on > 0 and (char != ":" or self.kind(level) == "{")

    def piece(self, char: str) -> tuple[str, bool]:
        """Kind of the piece that ends here (item, value, key, or none where only space may stand), and whether it may be blank."""
        on = self.on
        if on == 0 or char in "[{" or self.phase[on] == 2:
            return "none", True
        if self.kind(on) == "[":
            return "item" if on == self.deepest else "value", char == "]" and self.index[on] == 0
        if self.phase[on] == 1:
            return "value", False
        return ("key", False) if char == ":" else ("none", char == "}" and self.index[on] == 0)

    def move(self, char: str, key: str | None = None, times: int = 1) -> None:
        on = self.on
        if char in "[{":
            self.on = on = on + 1
            self.index[on], self.phase[on], self.key[on] = 0, 0, None
            if self.root == "{" and on == 2:
                self.exported = self.index[1]
            if on == 3:
                self.tabs = False
            if on == 4:
                self.bad, self.tabs = self.bad or self.tabs, True
        elif char == ",":
            self.index[on] += times
            self.phase[on] = 0
        elif char == ":":
            self.bad = self.bad or self.phase[on] != 0
            self.key[on], self.phase[on] = key, 1
        else:
            self.bad = self.bad or {"[": "]", "{": "}"}[self.kind(on)] != char
            self.on = on - 1
            self.phase[on - 1] = 2

    def place(self) -> tuple:
        """Names the current piece within its document."""
        return (self.on, self.phase[self.on], *(self.index[k] if k <= self.on else 0 for k in range(1, 5)))


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, list[str], list[int], str]:
    """Bytes of a block; place, character and level of its structure down to the records; and the document's first bracket."""
    data = np.frombuffer(row["text"].encode(), "u1")
    places, _, _ = lex(data, row["in_string"], row["escaped"])
    found = data[places]
    after = row["depth"] + np.cumsum(_STEP[found])
    level = after + (_STEP[found] < 0)  # a closing bracket belongs to what it closes
    root = row["root"] or _first_bracket(found)
    near = level <= Path(root).deepest
    return data, places[near], [chr(c) for c in found[near].tolist()], level[near].tolist(), root


def _between(data: np.ndarray, a: int, b: int) -> str:
    return data[a:b].tobytes().decode()


def _sample(data: np.ndarray, a: int, b: int) -> tuple[str, str]:
    """The first characters of a text, as they are and without leading space."""
    text = _between(data, a, b)
    return text[:_KEY], text.lstrip(_SPACE)[:_KEY]


def _path_sums(row: dict) -> Iterator[tuple]:
    """Runs of equal structure (character, level, times, text before it as far as a key or blank goes), and the text after."""
    data, places, chars, levels, root = _tokens(row)
    runs: list[list] = []
    at = 0
    for place, char, level in zip(places.tolist(), chars, levels):
        # Only an even comma of records repeats: there the text between does not matter.
        if char == "," and runs and runs[-1][0] == "," and runs[-1][1] == level and level == Path(root).deepest:
            runs[-1][2] += 1
        else:
            runs.append([char, level, 1, *(_sample(data, at, place) if char in ":[{" else ("", ""))])
        at = place + 1
    yield row["filename"], row["first"], row["part"], root, json.dumps([runs, _sample(data, at, len(data))])


_PATH_SUMS = pa.schema(
    [("filename", pa.string()), ("first", pa.int64()), ("part", pa.int32()), ("root", pa.string()), ("runs", pa.string())]
)


def _path_step(path: Path, row: dict) -> Path:
    path.root = path.root or row["root"]
    runs, tail = json.loads(row["runs"])
    for char, level, times, raw, trimmed in runs:
        before = (path.text + raw)[:_KEY] if path.text else trimmed
        if level <= 0 and char in "]}":
            path.bad = True
        if path.cuts(char, level, not before.strip(_SPACE)):
            path.move(char, _key_of(before.strip(_SPACE)) if char == ":" else None, times)
            path.text = ""
        elif char not in "]}":
            path.text = "\x00"  # off the way: what follows is part of a value, never a key or blank
    path.text = (path.text + tail[0])[:_KEY] if path.text else tail[1]
    return path


def _pieces(row: dict) -> Iterator[tuple]:
    """Pieces that end, begin or lie in a block."""
    data, places, chars, levels, root = _tokens(row)
    path = Path.read(root, row["path"])
    name, first, part = row["filename"], row["first"], row["part"]
    at, whole, marked = 0, False, bool(path.text)
    for place, char, level in zip(places.tolist(), chars, levels):
        between = None
        if char in "[{":
            between = _between(data, at, place)
            blank = not marked and not between.strip(_SPACE)
        else:
            blank = False
        if not path.cuts(char, level, blank):
            continue
        text = _between(data, at, place) if between is None else between
        kind, blank_ok = path.piece(char)
        empty = not text.strip(_SPACE)
        if not (whole and empty and blank_ok):
            yield (name, first, part, *path.place(), text, kind, blank_ok, whole)
        path.move(char, _key_of((path.text + text if not whole else text).strip(_SPACE)) if char == ":" else None)
        at, whole, marked = place + 1, True, False
    rest = _between(data, at, len(data))
    if rest:
        yield (name, first, part, *path.place(), rest, None, None, False)


_INDEXES = ["i1", "i2", "i3", "i4"]
_PIECE = pa.schema(
    [("filename", pa.string()), ("first", pa.int64()), ("part", pa.int32()), ("level", pa.int32()), ("phase", pa.int32())]
    + [(i, pa.int64()) for i in _INDEXES]
    + [("text", pa.string()), ("kind", pa.string()), ("blank_ok", pa.bool_()), ("whole", pa.bool_())]
)
_PIECE_DDL = (
    "filename string, first long, part int, level int, phase int, i1 long, i2 long, i3 long, i4 long, "
    "text string, kind string, blank_ok boolean, whole boolean"
)


def _text_of(v: Column, path: str) -> Column:
    """String at a path of a variant, NULL for any other type."""
    is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    return F.when(is_text, F.try_variant_get(v, path, "string"))


@dataclass(frozen=True)
class JsonScan:
    """What was read from JSON documents, once for all who ask.

    ``records`` are ``(filename, i1, i2, i3, i4, text, url, title, any_title)``: place, the record itself if it is a
    string, and its fields. ``verdicts`` are ``(filename, root, valid, exported)``: the first bracket, whether the
    whole is valid JSON, and the number of the member that holds a backup's groups (the last of that name) or -1.
    """

    records: DataFrame
    verdicts: DataFrame

    def exports(self) -> DataFrame:
        """Files that are backups: valid, with an array of groups."""
        return self.verdicts.filter("valid AND root = '{' AND exported >= 0").select("filename", "exported")

    def array_items(self) -> DataFrame:
        """``(filename, pos, url, title)`` of the elements of arrays."""
        arrays = self.verdicts.filter("valid AND root = '['").select("filename")
        return self.records.join(arrays, "filename", "left_semi").select(
            "filename", F.col("i1").alias("pos"), F.coalesce("text", "url").alias("url"), F.coalesce("title", F.lit("")).alias("title")
        )

    def tabs(self) -> DataFrame:
        """``(filename, pos, url, title)`` of the tabs of backups; group and tab number make the position."""
        rows = self.records.join(self.exports(), "filename").filter("i1 = exported")
        return rows.select(
            "filename", (F.shiftleft("i2", 32) + F.col("i4")).alias("pos"), "url", F.coalesce("any_title", F.lit("")).alias("title")
        )


def scan_json(lines: DataFrame, size: int = BLOCK, joiner: str = "\n") -> JsonScan:
    """Read the JSON documents of ``lines (filename, pos, line)`` record by record."""
    blocks = text_blocks(lines, size, joiner)
    sums = blocks.mapInArrow(
        _task(_depth_sums, _DEPTH_SUMS), "filename string, first long, part int, exits array<int>, nets array<long>, roots array<string>"
    )
    deep = folded(sums, _Depth, _depth_step, "in_string int, escaped int, depth long, root string", ends=True)
    roots = deep.filter("part = -1").select("filename", "root", (F.col("in_string") == 0).alias("closed"))
    entered = _entered(blocks, deep.filter("part >= 0"))
    runs = entered.mapInArrow(_task(_path_sums, _PATH_SUMS), "filename string, first long, part int, root string, runs string")
    paths = folded(runs, lambda: Path(""), _path_step, "path string, exported long, done boolean", ends=True)
    ends = paths.filter("part = -1").select("filename", "exported", "done")
    pieces = _entered(entered, paths.filter("part >= 0").select(*_PLACE, "path")).mapInArrow(_task(_pieces, _PIECE), _PIECE_DDL)
    pieces = cut_lineage(pieces)
    parts = F.array_join(F.array_sort(F.collect_list(F.struct("first", "part", "text")))["text"], "")
    joined = pieces.filter("NOT whole").groupBy("filename", "level", "phase", *_INDEXES).agg(
        parts.alias("text"), F.max("kind").alias("kind"), F.max("blank_ok").alias("blank_ok")
    )
    columns = ["filename", "level", *_INDEXES, "text", "kind", "blank_ok"]
    every = pieces.filter("whole").select(*columns).unionByName(joined.select(*columns))
    space = is_blank(F.col("text"))  # after the document any white space may stand, elsewhere JSON's own
    plain = ~F.col("text").rlike(r"[^ \t\r\n]")
    v = F.try_parse_json(F.concat(F.lit("["), F.col("text"), F.lit("]")))
    parsed = every.withColumn("v", F.when(F.col("kind").isin("item", "value", "key"), v))
    is_key = F.schema_of_variant(F.try_variant_get("v", "$[0]", "variant")) == "STRING"
    valid = (
        F.when(F.col("level") == 0, space)
        .when(plain, F.coalesce("blank_ok", F.lit(False)))
        .when(F.col("kind") == "key", is_key)
        .when(F.col("kind").isin("item", "value"), F.col("v").isNotNull())
        .otherwise(False)
    )
    first = lambda path: _text_of(F.col("v"), path)
    checked = cut_lineage(
        parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))
        .filter((F.col("kind") == "item") & ~plain | ~F.col("valid"))
        .select(
            "filename", *_INDEXES, "valid", first("$[0]").alias("text"), first("$[0].url").alias("url"),
            first("$[0].title").alias("title"), F.try_variant_get("v", "$[0].title", "string").alias("any_title"),
        )
    )
    broken = checked.filter("NOT valid").select("filename").distinct().withColumn("broken", F.lit(True))
    verdicts = cut_lineage(
        roots.join(ends, "filename")
        .join(broken, "filename", "left")
        .select("filename", "root", (F.col("done") & F.col("closed") & F.col("broken").isNull()).alias("valid"), "exported")
    )
    return JsonScan(checked.filter("valid").drop("valid"), verdicts)


# --- HTML: anchors ----------------------------------------------------------------------------------

# Fixed value: what a bookmark looks like.
ANCHOR = r'(?i)<A[ \t\n\x0B\f\r]+HREF="([^"]+)"[^>]*>([^<]*)</A>'
_ANCHOR = re.compile(ANCHOR)
#: Beginnings of an anchor, one for each state of a reader half-way through it.
_BEGUN = ["", "<", "<A", "<A ", "<A H", "<A HR", "<A HRE", "<A HREF", "<A HREF=", '<A HREF="', '<A HREF="x']
_BEGUN += ['<A HREF="x"', '<A HREF="x">', '<A HREF="x"><', '<A HREF="x"></', '<A HREF="x"></A']
_STEPS = ["A", r"[ \t\n\x0B\f\r]+", "H", "R", "E", "F", "=", '"', '[^"]+', '"[^>]*', ">[^<]*", "<", "/", "A"]


def _unfinished() -> re.Pattern:
    """An anchor that has begun and reaches the end; as many groups match as steps are done."""
    tail = ""
    for step in reversed(_STEPS):
        tail = f"({step}{tail})?"
    return re.compile(f"(?i)<{tail}\\Z")


_OPEN = _unfinished()


def _read_anchors(text: str) -> tuple[list[re.Match], int, int]:
    """Anchors of a text, the state at its end, and where what is open there begins."""
    found = list(_ANCHOR.finditer(text))
    after = found[-1].end() if found else 0
    open_ = _OPEN.search(text, after)
    if open_ is None:
        return found, 0, len(text)
    return found, 1 + sum(g is not None for g in open_.groups()), open_.start()


def _anchor_sums(row: dict) -> Iterator[tuple]:
    """For each state to begin in: the state at the end, the anchors, and whether one is open all through."""
    read = [_read_anchors(begun + row["text"]) for begun in _BEGUN]
    yield (
        row["filename"], row["first"], row["part"],
        [state for _, state, _ in read], [len(found) for found, _, _ in read],
        [state > 0 and begun != "" and start == 0 for (_, state, start), begun in zip(read, _BEGUN)],
    )


_ANCHOR_SUMS = pa.schema(
    [("filename", pa.string()), ("first", pa.int64()), ("part", pa.int32()), ("exits", pa.list_(pa.int32())),
     ("counts", pa.list_(pa.int64())), ("through", pa.list_(pa.bool_()))]
)


@dataclass
class _Anchors:
    state: int = 0
    before: int = 0
    since: int | None = None  # block in which the open anchor begins
    since_part: int | None = None

    def row(self) -> tuple:
        return self.state, self.before, self.since, self.since_part


def _anchor_step(now: _Anchors, row: dict) -> _Anchors:
    state, before = row["exits"][now.state], now.before + row["counts"][now.state]
    if not state:
        return _Anchors(0, before)
    if row["through"][now.state]:
        return _Anchors(state, before, now.since, now.since_part)
    return _Anchors(state, before, row["first"], row["part"])


def _anchors(row: dict) -> Iterator[tuple]:
    """Anchors inside a block, and its parts of anchors that cross blocks."""
    begun, text = _BEGUN[row["state"]], row["text"]
    found, state, start = _read_anchors(begun + text)
    name, first, part, before = row["filename"], row["first"], row["part"], row["before"]
    for k, m in enumerate(found):
        if m.start() == 0 and begun:
            yield name, before + k, None, None, row["since"], row["since_part"], first, part, text[: m.end() - len(begun)]
        else:
            yield name, before + k, m.group(1), m.group(2), None, None, first, part, None
    if state and begun and start == 0:
        yield name, None, None, None, row["since"], row["since_part"], first, part, text
    elif state:
        yield name, None, None, None, first, part, first, part, text[start - len(begun) :]


_FOUND = pa.schema(
    [("filename", pa.string()), ("pos", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("since", pa.int64()),
     ("since_part", pa.int32()), ("first", pa.int64()), ("part", pa.int32()), ("text", pa.string())]
)


def scan_anchors(lines: DataFrame, size: int = BLOCK, joiner: str = "\n") -> DataFrame:
    """``(filename, pos, url, title)`` of the bookmarks of HTML documents, numbered in their order."""
    blocks = text_blocks(lines, size, joiner)
    sums = blocks.mapInArrow(
        _task(_anchor_sums, _ANCHOR_SUMS),
        "filename string, first long, part int, exits array<int>, counts array<long>, through array<boolean>",
    )
    states = folded(sums, _Anchors, _anchor_step, "state int, before long, since long, since_part int")
    found = cut_lineage(
        _entered(blocks, states).mapInArrow(
            _task(_anchors, _FOUND),
            "filename string, pos long, url string, title string, since long, since_part int, first long, part int, text string",
        )
    )
    parts = F.array_join(F.array_sort(F.collect_list(F.struct("first", "part", "text")))["text"], "")
    crossing = found.filter("since IS NOT NULL").groupBy("filename", "since", "since_part").agg(
        F.max("pos").alias("pos"), parts.alias("text")
    )
    part_of = lambda k: F.regexp_extract("text", ANCHOR, k)
    crossed = crossing.filter("pos IS NOT NULL").select("filename", "pos", part_of(1).alias("url"), part_of(2).alias("title"))
    return found.filter("since IS NULL").select("filename", "pos", "url", "title").unionByName(crossed)
