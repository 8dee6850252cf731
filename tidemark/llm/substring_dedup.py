"""Operator 5, substring duplicates: suffix automata of reference shards, matching statistics, removal of covered spans.

A word goes when some window of ``WINDOW`` consecutive words around it also starts in a document with a smaller doc_id. Sending
every document past the automaton of every reference shard would cost documents times shards, so each window is sent only to
the shard that holds all windows equal to it: a window's anchor is the least hash of its ``GRAM``-word grams, and equal
windows have equal anchors. Neighbouring windows with one anchor form a run, which is handled as one string.

1. Slices of documents (a few MB, scanned in a fixed order) list their distinct runs: anchor, hash, smallest doc_id.
2. Runs meet by anchor. Anchors in one document only are done. A repeated run that is the only string of its anchor
   matches itself in full, and its smallest doc_id is the answer for all of its windows.
3. Slices send the text of the other runs to reference shards, by anchor. An anchor with very many strings (a common
   line in different surroundings) is split by window, so a shard's size is bounded. The shard builds the suffix automaton
   of its strings, marks each state with the smallest doc_id in which its factors end, and streams the strings for
   matching statistics; a match of WINDOW words has the answer at the state of its last WINDOW words.
4. Slices mark the windows whose answer is smaller than their doc_id, and remove the maximal covered spans.

Only what the slices send and keep after step 2 is written to files, and the shuffles before it are removed then; all else is
shuffled from step to step. Files are dear where Hadoop's local file system lacks its native library: it starts a process for
each one's permissions, which seems to hold the executor's whole memory once more until it has begun.

Rows of a slice that share a string count once, so no string, however common, gives more rows than there are slices.
Answers return by slice. A slice's id is a hash of its rows; a scan that cut slices differently would find no answers and is an error.

Defined cases: a null text has no words; a document of fewer than WINDOW words loses none; a null doc_id is larger than all
others; rows with one doc_id are no sources for each other, and repeated rows are treated alike; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.joins import shuffles_removed, written
from tidemark.llm.textkit import BLANKS, Words, grams, map_slices, mix, ranges, raw_bytes, text_of

WINDOW, GRAM = 13, 5
SPLIT_ROWS, SHARD_WORDS, SLICE = 256, 50_000, 4 << 20
NO_ID = np.iinfo(np.int64).max


class Runs:
    """Windows of a slice, in runs of neighbours with one anchor."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.window, self.ids = window, ids
        self.data, bounds = raw_bytes(texts)
        self.words = words = Words(self.data, bounds, BLANKS)
        doc = words.doc_of()
        full = grams(words.hash, window)
        small = grams(words.hash, gram)
        least, reach, need = small, 1, window - gram + 1
        while reach < need:
            step = min(reach, need - reach)
            least = np.minimum(least[: max(len(least) - step, 0)], least[step:])
            reach += step
        fits = doc[: len(full)] == doc[window - 1 :] if len(full) else np.zeros(0, bool)
        self.starts = np.flatnonzero(fits)  # first word of each window
        self.hash, anchors, docs = full[fits], least[: len(full)][fits], doc[self.starts]
        new = np.ones(len(self.starts), bool)
        new[1:] = (np.diff(anchors) != 0) | (np.diff(docs) != 0)
        self.first = np.flatnonzero(new)  # first window of each run
        self.length = np.diff(np.append(self.first, len(new)))
        self.anchor, self.doc = anchors[self.first], docs[self.first]
        place = ranges(np.ones(len(self.first), np.int64), self.length).astype(np.uint64)
        self.key = mix(np.add.reduceat(self.hash * mix(place), self.first) + self.length.astype(np.uint64)) if len(self.first) else self.hash

    def string(self, first_window: int, windows: int) -> bytes:
        low = self.starts[first_window]
        return self.data[self.words.starts[low] : self.words.ends[low + windows + self.window - 2]].tobytes()

    def covered(self, hits: np.ndarray) -> np.ndarray:
        """Words inside a window of ``hits`` (one flag per window)."""
        marks = np.zeros(len(self.words.starts) + self.window + 1, np.int64)
        np.add.at(marks, self.starts[hits], 1)
        np.add.at(marks, self.starts[hits] + self.window, -1)
        return np.cumsum(marks)[: len(self.words.starts)] > 0

    def distinct(self, *keys: np.ndarray, owners: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, one place of each, its smallest owner, and whether it has several."""
        order = np.lexsort((owners, *keys[::-1]))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
        first = np.flatnonzero(new)
        owner = owners[order]
        last = np.append(first[1:], len(order)) - 1
        return [k[order][first] for k in keys], order[first], owner[first], owner[first] != owner[last] if len(order) else np.zeros(0, bool)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def slice_id(piece: pa.RecordBatch) -> int:
    seen = xxhash.xxh3_64(repr(piece.column("doc_id").to_pylist()).encode())
    data, bounds = raw_bytes(text_of(piece))
    seen.update(bounds.tobytes())
    seen.update(data.tobytes())
    return seen.intdigest() - (1 << 63)


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array([NO_ID if v is None else v for v in column.to_pylist()], np.int64)


def list_runs(docs: DataFrame) -> DataFrame:
    """Distinct runs of each slice, and one row without anchor for the slice itself."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        runs = Runs(ids_of(piece.column("doc_id")), text_of(piece))
        (anchor, key), _, least, several = runs.distinct(runs.anchor, runs.key, owners=runs.ids[runs.doc] if len(runs.doc) else np.zeros(0, np.int64))
        n = len(anchor)
        columns = [
            pa.concat_arrays([pa.nulls(1, pa.int64()), signed(anchor)]), pa.concat_arrays([pa.nulls(1, pa.int64()), signed(key)]),
            pa.array(np.full(n + 1, slice_id(piece))), pa.array(np.append(NO_ID, least)), pa.array(np.append(False, several)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "key", "slice", "least", "several"])

    return map_slices(docs, run, limit=SLICE, schema="anchor long, key long, slice long, least long, several boolean")


def meet(listed: DataFrame) -> DataFrame:
    """Answers (slice, key, least, splits). splits 0: least answers for all windows; else: send the text, split so many ways."""
    partitions = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = listed.repartition(partitions, F.coalesce("anchor", "slice")).sortWithinPartitions("anchor")

    def answer(anchor: np.ndarray, key: np.ndarray, slices_: np.ndarray, least: np.ndarray, several: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, np.diff(anchor) != 0))
        size = np.diff(np.append(first, len(anchor)))
        low = np.minimum.reduceat(least, first)
        repeated = (low < np.maximum.reduceat(least, first)) | np.logical_or.reduceat(several, first)
        single = np.minimum.reduceat(key, first) == np.maximum.reduceat(key, first)
        splits = np.where(single, 0, -(-size // SPLIT_ROWS))
        rows = np.repeat(repeated, size)
        return pa.RecordBatch.from_arrays([pa.array(slices_[rows]), pa.array(key[rows]), pa.array(np.repeat(low, size)[rows]), pa.array(np.repeat(splits, size)[rows])], ["slice", "key", "least", "splits"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            heads = batch.filter(batch.column("anchor").is_null())
            if heads.num_rows:
                empty = pa.nulls(heads.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([heads.column("slice"), empty, empty, empty], ["slice", "key", "least", "splits"])
            batch = batch.filter(batch.column("anchor").is_valid())
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "key", "slice", "least", "several")]
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on
            if cut:
                yield answer(*(r[:cut] for r in rows))
            held = [r[cut:] for r in rows]
        if held is not None:
            yield answer(*held)

    return dealt.mapInArrow(run, "slice long, key long, least long, splits long")


OUTCOME = "kind string, slice long, rows binary, text string, anchor long, part long, key long, least long, several boolean"
_EMPTY = {"kind": pa.string(), "slice": pa.int64(), "rows": pa.binary(), "text": pa.string(), "anchor": pa.int64(), "part": pa.int64(), "key": pa.int64(), "least": pa.int64(), "several": pa.bool_()}
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def outcome(kind: str, n: int, **columns: pa.Array) -> pa.Table:
    columns["kind"] = pa.array([kind] * n, pa.string())
    return pa.table({c: columns.get(c, pa.nulls(n, t)).cast(t) for c, t in _EMPTY.items()})


def kept_words(text: str, covered: np.ndarray) -> tuple[int, int, str]:
    words = text.encode().split()
    kept = compress(words, (~covered).tolist()) if covered.any() else words
    return len(words), int(covered.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def finished(doc_id: list, texts: list[str], covered: list[np.ndarray]) -> pa.Table:
    rows = [kept_words(t, c) for t, c in zip(texts, covered, strict=True)]
    n_words, n_removed, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"doc_id": pa.array(doc_id, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def packed(rows: pa.Table) -> bytes:
    """A slice's rows as one compressed value: slices are moved whole, and text shrinks far more this way than row by row."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=None)) as writer:
        writer.write_table(rows)
    return zstandard.ZstdCompressor(3).compress(sink.getvalue())


def unpacked(values: list[bytes]) -> pa.Table:
    """Rows of one or more equal slices."""
    return pa.concat_tables([pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(v)).read_all() for v in values])


def first_pass(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Finish documents whose windows are all answered; ask for the others. Both go on in one value of the slice."""
    if not docs.num_rows:
        return outcome("open", 0)
    name = docs.column("slice")[0].as_py()
    docs = unpacked(docs.column("rows").to_pylist())
    keys = answers.column("key").to_numpy(zero_copy_only=False)
    if not answers.column("key").null_count:
        raise ValueError("the documents were cut into other slices than before")
    answers = answers.filter(answers.column("key").is_valid())
    keys = answers.column("key").to_numpy()
    order = np.argsort(keys)
    keys, least, splits = keys[order], answers.column("least").to_numpy()[order], answers.column("splits").to_numpy()[order]
    texts = text_of(docs.combine_chunks().to_batches()[0])
    runs = Runs(ids_of(docs.column("doc_id")), texts)
    own = runs.key.view(np.int64)
    at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
    known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
    owner = runs.ids[runs.doc] if len(own) else np.zeros(0, np.int64)
    asks = known & (splits[at] > 0) if len(keys) else known
    hit = known & ~asks & (least[at] < owner) if len(keys) else known
    covered = runs.covered(np.repeat(hit, runs.length))
    waiting = np.zeros(docs.num_rows, bool)
    waiting[runs.doc[asks]] = True
    parts = [covered[a:b] for a, b in zip(runs.words.offsets[:-1].tolist(), runs.words.offsets[1:].tolist(), strict=True)]
    doc_ids, values = docs.column("doc_id").to_pylist(), texts.to_pylist()
    pick = lambda rows, of: [rows[i] for i in np.flatnonzero(of).tolist()]
    done = finished(pick(doc_ids, ~waiting), pick(values, ~waiting), pick(parts, ~waiting))
    bits = [np.packbits(c).tobytes() for c in pick(parts, waiting)]
    left = pa.table({"doc_id": pa.array(pick(doc_ids, waiting), pa.int64()), "text": pa.array(pick(values, waiting), pa.string()), "covered": pa.array(bits, pa.binary())})
    out = [outcome("open", 1, slice=pa.array([name]), rows=pa.array([packed(pa.concat_tables([done, left], promote_options="default"))]))]
    whole, cut = np.flatnonzero(asks & (splits[at] == 1)) if len(keys) else own[:0], np.flatnonzero(asks & (splits[at] > 1)) if len(keys) else own[:0]
    window = ranges(runs.first[cut], runs.length[cut]) if len(cut) else np.zeros(0, np.int64)
    run_of = np.repeat(cut, runs.length[cut]) if len(cut) else np.zeros(0, np.int64)
    part = (runs.hash[window] % splits[at[run_of]].astype(np.uint64)).astype(np.int64) + 1 if len(cut) else np.zeros(0, np.int64)
    asked = (np.concatenate([runs.anchor[whole], runs.anchor[run_of]]), np.concatenate([np.zeros(len(whole), np.int64), part]), np.concatenate([runs.key[whole], runs.hash[window]]))
    windows = np.concatenate([runs.first[whole], window])
    lengths = np.concatenate([runs.length[whole], np.ones(len(window), np.int64)])
    (anchor, part, key), place, low, several = runs.distinct(*asked, owners=np.concatenate([owner[whole], owner[run_of]]))
    strings = [runs.string(w, k).decode() for w, k in zip(windows[place].tolist(), lengths[place].tolist(), strict=True)]
    out.append(outcome("ask", len(anchor), slice=pa.array(np.full(len(anchor), name)), anchor=signed(anchor), part=pa.array(part), key=signed(key), text=pa.array(strings, pa.string()), least=pa.array(low), several=pa.array(several)))
    return pa.concat_tables(out)


class Shard:
    """Reference strings of some anchors, and who asks for them."""

    def __init__(self):
        self.strings: list[list[bytes]] = []
        self.least: list[int] = []
        self.asked: list[list[tuple[int, int, int, bool]]] = []
        self.size = 0

    def add(self, text: str, rows: list[tuple[int, int, int, bool]]) -> None:
        self.strings.append(text.encode().split())
        self.least.append(min(r[2] for r in rows))
        self.asked.append(rows)
        self.size += len(self.strings[-1])

    def answers(self, window: int = WINDOW) -> list[tuple[int, int, list[int]]]:
        """(slice, key, smallest doc_id of each window) where it can matter to the slice."""
        number: dict[bytes, int] = {}
        coded = [[number.setdefault(w, len(number)) for w in s] for s in self.strings]
        automaton = SuffixAutomaton()
        prefixes = [automaton.add(s) for s in coded]
        least = [NO_ID] * len(automaton.size)
        for states, low in zip(prefixes, self.least, strict=True):
            for state in states:
                if low < least[state]:
                    least[state] = low
        for state in automaton.by_size():
            parent = automaton.link[state]
            if least[state] < least[parent]:
                least[parent] = least[state]
        out = []
        for string, rows in zip(coded, self.asked, strict=True):
            statistics = automaton.statistics(string)[window - 1 :]
            lows = [least[automaton.suffix_state(state, window)] if length >= window else NO_ID for state, length in statistics]
            out += [(name, key, lows) for name, key, own, several in rows if several or min(lows) < own]
        return out


def match_shards(asks: DataFrame) -> DataFrame:
    """Answers (slice, key, lows) from the automata of all shards."""
    partitions = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["anchor", "part", "key", "text", "slice", "least", "several"]
    dealt = asks.select(columns).repartition(partitions, "anchor", "part").sortWithinPartitions("anchor", "part", "key", "slice")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

    def emit(shard: Shard) -> pa.RecordBatch | None:
        found = shard.answers()
        if not found:
            return None
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["slice", "key", "lows"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for _, group in groupby(rows(batches), key=lambda r: r[:2]):
            if shard.size >= SHARD_WORDS:  # all strings of an anchor's part share a shard
                if (out := emit(shard)) is not None:
                    yield out
                shard = Shard()
            for _, same in groupby(group, key=lambda r: r[2]):
                same = list(same)
                shard.add(same[0][3], [(r[4], r[2], r[5], r[6]) for r in same])
        if shard.size and (out := emit(shard)) is not None:
            yield out

    return dealt.mapInArrow(run, "slice long, key long, lows array<long>")


def second_pass(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """All documents of a slice: those finished before, and the waiting ones, which have a text."""
    if not docs.num_rows:
        return finished([], [], [])
    docs = unpacked(docs.column("rows").to_pylist())
    waits = docs.column("text").is_valid()
    done, docs = docs.filter(pc.invert(waits)).select(["doc_id", "n_words", "n_removed", "kept_sha256"]), docs.filter(waits)
    if not docs.num_rows:
        return done
    texts = text_of(docs.combine_chunks().to_batches()[0])
    runs = Runs(ids_of(docs.column("doc_id")), texts)
    lows = dict(zip(answers.column("key").to_pylist(), answers.column("lows").to_pylist(), strict=True))
    hits = np.zeros(len(runs.starts), bool)
    if lows:
        keys = np.array(sorted(lows), np.int64)
        for r in np.flatnonzero(np.isin(runs.key.view(np.int64), keys)).tolist():
            first, n = int(runs.first[r]), int(runs.length[r])
            hits[first : first + n] |= np.array(lows[int(runs.key[r].view(np.int64))]) < runs.ids[runs.doc[r]]
        owner = np.repeat(runs.ids[runs.doc], runs.length) if len(runs.doc) else np.zeros(0, np.int64)
        for w in np.flatnonzero(np.isin(runs.hash.view(np.int64), keys)).tolist():
            found = lows[int(runs.hash[w].view(np.int64))]
            hits[w] |= len(found) == 1 and found[0] < owner[w]
    covered = runs.covered(hits)
    parts = []
    for a, b, bits in zip(runs.words.offsets[:-1].tolist(), runs.words.offsets[1:].tolist(), docs.column("covered").to_pylist(), strict=True):
        parts.append(covered[a:b] | np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool))
    return pa.concat_tables([done, finished(docs.column("doc_id").to_pylist(), texts.to_pylist(), parts)])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def tag(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slice_id(piece)]), pa.array([packed(pa.table({"doc_id": piece.column("doc_id"), "text": text_of(piece)}))])], ["slice", "rows"])

    answers = meet(list_runs(docs))
    tagged = map_slices(docs, tag, "slice long, rows binary", limit=SLICE)
    with shuffles_removed(docs.sparkSession):
        first = written(tagged.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(first_pass, OUTCOME))
    found = match_shards(first.where("kind = 'ask'"))
    left = first.where("kind = 'open'").select("slice", "rows")
    return left.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(second_pass, RESULT)
