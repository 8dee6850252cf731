"""The "feed" data source: events of a Parquet table in sequence order, in batch and as a stream.

Options: ``path`` (a folder or file the executors can read), ``sequence`` (the ordering column), ``maxEventsPerBatch``, ``batchesAtOnce`` (how many such
batches Spark may plan as one; the strict runner's turns keep them apart), one of ``startAfter`` (a token, exclusive), ``startSeq`` (inclusive) or ``latest``,
and ``oldest`` (the first event kept; asking for earlier ones is lost history).
Parts and batches are cut by numbers of events, which row groups' statistics give; numbers themselves may be as sparse as they like. Footers are
read once per file, and a part opens only the files that hold some of it. A stream's offset is the last sequence number delivered, so a restart delivers the batch that was not committed again, row for row.
A plain ``spark.readStream.parquet`` suits feeds that need no order across files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fractions import Fraction
from itertools import pairwise
from typing import Any, NamedTuple

import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.resume import HistoryLostError

PART_EVENTS = 50_000


class Range(InputPartition):
    """Events with numbers in (low, high], and the files that hold them."""

    def __init__(self, low: int, high: int, files: list[str]):
        super().__init__((low, high))
        self.low, self.high, self.files = low, high, files


class Group(NamedTuple):
    """Events of one row group."""

    file: str
    low: int
    high: int
    rows: int


class _Table:
    def __init__(self, options: dict):
        self.path, self.order = options["path"], options.get("sequence", "event_id")
        self.oldest = int(options.get("oldest", 0))
        self.seen: dict[tuple, list[Group]] = {}

    def groups(self) -> list[Group]:
        """All row groups; footers of known files aren't read again."""
        table = ds.dataset(self.path)
        now = {}
        for fragment in table.get_fragments():
            info = fragment.filesystem.get_file_info(fragment.path)
            key = (fragment.path, info.size, info.mtime_ns)
            now[key] = self.seen[key] if key in self.seen else list(self._footer(fragment))
        self.seen = now
        return [g for found in now.values() for g in found]

    def _footer(self, fragment: Any) -> Iterator[Group]:
        fragment.ensure_complete_metadata()
        at = fragment.physical_schema.get_field_index(self.order)
        for k in range(fragment.metadata.num_row_groups):
            stats, rows = fragment.metadata.row_group(k).column(at).statistics, fragment.metadata.row_group(k).num_rows
            if stats is not None and stats.has_min_max:
                yield Group(fragment.path, stats.min, stats.max, rows)
            elif rows:
                ends = pc.min_max(fragment.subset(row_group_ids=[k]).to_table(columns=[self.order]).column(0)).as_py()
                yield Group(fragment.path, ends["min"], ends["max"], rows)

    def bounds(self) -> tuple[int, int]:
        """Oldest and newest number."""
        groups = self.groups()
        return max(self.oldest, min((g.low for g in groups), default=0)), max((g.high for g in groups), default=-1)

    def check(self, after: int) -> None:
        if after + 1 < self.oldest:
            raise HistoryLostError(f"{self.path}: events after {after} were asked for, the oldest kept is {self.oldest}")

    def read(self, part: Range, columns: list[str]) -> Iterator:
        if not part.files:
            return
        order = ds.field(self.order)
        whole = ds.dataset(self.path)
        table = ds.dataset(part.files, schema=whole.schema, filesystem=next(whole.get_fragments()).filesystem)
        found = table.to_table(columns=list(dict.fromkeys([*columns, self.order])), filter=(order > part.low) & (order <= part.high))
        yield from found.sort_by(self.order).select(columns).to_batches(max_chunksize=10_000)


def within(groups: list[Group], low: int, high: int) -> list[Group]:
    """Row groups with numbers in (low, high]; a group's rows are taken as even over its numbers."""
    found = []
    for g in groups:
        first, last = max(g.low, low + 1), min(g.high, high)
        if first <= last:
            found.append(Group(g.file, first, last, max(1, round(g.rows * (last - first + 1) / (g.high - g.low + 1)))))
    return found


def cuts(groups: list[Group], every: int) -> Iterator[int]:
    """Numbers after each ``every`` or so events; the last is the groups' highest number."""
    edges = sorted({e for g in groups for e in (g.low - 1, g.high)})
    place = {e: k for k, e in enumerate(edges)}
    density = [Fraction(0)] * (len(edges) + 1)  # events per number between an edge and the next
    for g in groups:
        rate = Fraction(g.rows, g.high - g.low + 1)
        density[place[g.low - 1]] += rate
        density[place[g.high]] -= rate
    last, owed, rate = None, Fraction(0), Fraction(0)
    for k, (a, b) in enumerate(pairwise(edges)):
        rate += density[k]
        while rate and owed + rate * (b - a) >= every:
            a += max(1, int((every - owed) / rate))
            owed = Fraction(0)
            last = min(a, b)
            yield last
            if a >= b:
                break
        owed += rate * max(0, b - a)
    if edges and last != edges[-1]:
        yield edges[-1]


def parts(groups: list[Group], low: int, high: int) -> list[Range]:
    """Parts of (low, high] of about PART_EVENTS events."""
    inside = within(groups, low, high)
    ends = list(cuts(inside, PART_EVENTS))
    return [Range(a, b, sorted({g.file for g in inside if g.low <= b and g.high > a})) for a, b in zip([low, *ends[:-1]], ends, strict=True)] if ends else []


class FeedReader(DataSourceReader):
    def __init__(self, table: _Table, names: list[str], after: int):
        self.table, self.names, self.after = table, names, after

    def partitions(self) -> list[Range]:
        self.table.check(self.after)
        oldest, head = self.table.bounds()
        return parts(self.table.groups(), max(self.after, oldest - 1), head) or [Range(head, head, [])]

    def read(self, partition: Range) -> Iterator:
        return self.table.read(partition, self.names)


class FeedStreamReader(DataSourceStreamReader):
    def __init__(self, table: _Table, names: list[str], options: dict):
        self.table, self.names, self.options = table, names, options
        self.most = int(options.get("maxeventsperbatch", 10_000)) * int(options.get("batchesatonce", 1))
        self.reached: int | None = None

    def initialOffset(self) -> dict:
        oldest, head = self.table.bounds()
        if self.options.get("latest") == "true":
            return {"seq": head}
        after = start_after(self.options)
        if after is None:
            return {"seq": oldest - 1}
        self.table.check(after)
        return {"seq": after}

    def latestOffset(self) -> dict:
        """About ``maxEventsPerBatch`` events, ``batchesAtOnce`` times, beyond what has been planned, so that a batch is bounded."""
        if self.reached is None:
            self.reached = int(self.options.get("resumed", self.initialOffset()["seq"]))
        groups = self.table.groups()
        self.reached = next(cuts(within(groups, self.reached, max((g.high for g in groups), default=-1)), self.most), self.reached)
        return {"seq": self.reached}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.table.check(start["seq"])
        self.reached = end["seq"] if self.reached is None else max(self.reached, end["seq"])
        return parts(self.table.groups(), start["seq"], end["seq"])

    def read(self, partition: Range) -> Iterator:
        return self.table.read(partition, self.names)

    def commit(self, end: dict) -> None:
        """Nothing to release: the table keeps its events."""


def lowered(options: dict) -> dict:
    """Option names don't differ by case."""
    return {k.lower(): v for k, v in options.items()}


def start_after(options: dict) -> int | None:
    if "startafter" in options:
        return int(options["startafter"])
    if "startseq" in options:
        return int(options["startseq"]) - 1
    return None


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> StructType | str:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(ds.dataset(self.options["path"]).schema, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> FeedReader:
        after = start_after(lowered(self.options))
        return FeedReader(_Table(lowered(self.options)), schema.names, -1 if after is None else after)

    def streamReader(self, schema: StructType) -> FeedStreamReader:
        return FeedStreamReader(_Table(lowered(self.options)), schema.names, lowered(self.options))


def planned_offset(spark: SparkSession, location: str) -> int | None:
    """End of the last batch that a query with this checkpoint location has planned: Spark's own record, and the authority on progress."""
    try:
        logs = spark.read.format("text").option("wholetext", True).load(f"{location.rstrip('/')}/offsets/*").select("value", F.input_file_name().alias("file")).collect()  # Spark keeps the last 100 or so
    except AnalysisException:
        return None
    last = max(((int(r.file.rsplit("/", 1)[1]), r.value) for r in logs if r.file.rsplit("/", 1)[1].isdigit()), default=None)
    return None if last is None else int(json.loads(last[1].strip().splitlines()[-1])["seq"])


def stream_feed(spark: SparkSession, location: str, **options: Any) -> DataFrame:
    """The feed as a stream for a query with this checkpoint location. The reader isn't told where a restarted query stands, so it is passed on here."""
    spark.dataSource.register(FeedSource)
    resumed = planned_offset(spark, location)
    return spark.readStream.format("feed").options(**options, **({} if resumed is None else {"resumed": resumed})).load()


def drain(query: StreamingQuery) -> None:
    """Let a query with a processing-time trigger run batch after batch until its source has nothing more, then end it; raises what ends it early."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
