"""Sessions of out-of-order rows, closed by event time in a stateful stream.

State: clients share a group of the state by a hash, since every group costs a
trip to the state server and a batch of output.  A group has a ListState of its open
sessions (client, start, end, rows, sum of checksums, merges), read and written
whole once a batch, and one event-time timer, for the session that ends first.

A batch's watermark W(b) is the largest event time through batch b less
``late_hours``, to the microsecond.  Spark's own watermark has milliseconds, so
timers that fire in the last millisecond are judged again.  Rows of batch b below
W(b-1) are dropped.  Sessions that end more than a gap before W(b) close as batch
b: at once if rows of b complete them (such a session is never stored), with
the next rows of their group, or by their timer, whichever comes first.  What is
open in the end is read from the state with Spark's state reader.

Scale: rows are dealt by client with a rebalance, which splits a client that
holds many rows over tasks; each map task of the stream joins its own rows to
sessions first and sends one packed row a group, so a hot client costs its
sessions and not its rows.  A client has at most 48 sessions a day, which
bounds its state by the lateness and the span of a batch; the numbers of groups
and of state stores grow with the rows (``group_rows``, ``store_rows``), the latter
up to the session's shuffle partitions.  Every call works in a new folder under
``spark.checkpoint.dir``; a start that fails can be repeated on the same checkpoint.

Defined cases: rows without id, client or event time take no part; of rows that
repeat an id the one with the smallest (arrival, time, client) counts, no arrival
first; a row without arrival is in the first batch; an empty batch closes nothing;
equal times and rows just a gap apart share a session; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .common import shared_folder

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000

ROW = "client_id long, us long, ts timestamp, crc long"
CLOSED = "client_id long, first_us long, last_us long, n_clicks long, ids_crc32 long, n_merges long, close_batch long"
CLOSED_ROW = Row(*(part.split()[0] for part in CLOSED.split(", ")))

#: rows of a map task that are joined to sessions at once
BLOCK = 1 << 18
#: sessions of one group and batch that wait to be joined
PENDING = 100_000

#: what a stream of this operator sets in its own session
CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # a store would allot megabytes before its first row
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def joined_rows(group: np.ndarray, client: np.ndarray, us: np.ndarray, crc: np.ndarray, gap: int) -> tuple[np.ndarray, pa.Array]:
    """Groups and, for each, the sessions of its rows as packed (client, first, last, rows, checksums)."""
    order = np.lexsort((us, client, group))
    group, client, us, crc = group[order], client[order], us[order], crc[order]
    cut = np.r_[True, (client[1:] != client[:-1]) | (us[1:] - us[:-1] > gap) | (group[1:] != group[:-1])]
    starts = np.flatnonzero(cut)
    ends = np.r_[starts[1:], len(us)]
    packed = np.stack([client[starts], us[starts], us[ends - 1], ends - starts, np.add.reduceat(crc, starts)], axis=1)
    own = group[starts]
    firsts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    offsets = np.r_[firsts, len(starts)] * packed.itemsize * packed.shape[1]
    return own[firsts], pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(packed, dtype=np.int64))])


def joiner(gap: int):
    """Arrow mapper: (slot, client_id, us, crc) to one packed row a slot and block."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("slot", "client_id", "us", "crc")]
        slots, packed = joined_rows(*columns, gap)
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), packed], names=["slot", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= BLOCK:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return run


def join(parts: list[list], gap: int) -> list[list[list]]:
    """A client's parts in groups that lie at most a gap apart, in order.

    A part: first, last, rows, checksums, merges and, if it was left open before, its timer (else None).
    """
    groups: list[list[list]] = []
    end = 0
    for part in sorted(parts, key=lambda p: p[0]):
        if groups and part[0] - end <= gap:
            groups[-1].append(part)
            end = max(end, part[1])
        else:
            groups.append([part])
            end = part[1]
    return groups


def summed(group: list[list]) -> list:
    """The session of a group of parts, without a timer; it adds a merge for each further part left open before."""
    if len(group) == 1:
        return [*group[0][:5], None]
    old = sum(p[5] is not None for p in group)
    return [group[0][0], max(p[1] for p in group), *(sum(p[i] for p in group) for i in (2, 3)), sum(p[4] for p in group) + max(old - 1, 0), None]


class Sessions(StatefulProcessor):
    """Open sessions of a group of clients; floors: W of each batch so far, None before the first row."""

    def __init__(self, gap: int, floors: list[int | None]) -> None:
        self.gap, self.floors = gap, floors
        self.floor = floors[-1] if floors[-1] is not None else -(2**62)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "client long, first long, last long, n long, crc long, merges long, timer long")

    def due(self, part: list) -> bool:
        return part[1] + self.gap < self.floor

    def closed(self, client: int, part: list) -> Row:
        """With the first batch whose watermark has passed the session."""
        batch = next(b for b, w in enumerate(self.floors) if w is not None and part[1] + self.gap < w)
        return CLOSED_ROW(client, *part[:5], batch)

    def stored(self) -> tuple[dict[int, list[list]], int | None]:
        """The open sessions of the group by client, and the group's timer."""
        found, timer = {}, None
        for client, *part in self.open.get():
            found.setdefault(client, []).append(part)
            timer = part[5]
        return found, timer

    def keep(self, left: list[tuple[int, list]], before: int | None, least: int = 0) -> None:
        """Store what is left open of the group; its timer (was: before) fires from the watermark's millisecond which holds the first deadline."""
        timer = max((min(p[1] for _, p in left) + self.gap) // 1000 - 1, least) if left else None
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if timer is not None:
                self.handle.registerTimer(timer)
        if left:
            self.open.put([(client, *part[:5], timer) for client, part in left])
        else:
            self.open.clear()

    def fresh(self, rows) -> dict[int, list[list]]:
        found, held = {}, 0
        for row in rows:
            for client, *part in np.frombuffer(row["packed"], dtype=np.int64).reshape(-1, 5).tolist():
                found.setdefault(client, []).append([*part, 0, None])
                held += 1
            if held > PENDING:
                found = {c: [summed(g) for g in join(parts, self.gap)] for c, parts in found.items()}
                held = 0
        return {c: [summed(g) for g in join(parts, self.gap)] for c, parts in found.items()}

    def handleInputRows(self, key, rows, timerValues):
        fresh, (stored, timer) = self.fresh(rows), self.stored()
        left = []
        for client in fresh.keys() | stored.keys():
            for group in join([*fresh.get(client, []), *stored.get(client, [])], self.gap):
                session = summed(group)
                if self.due(session):
                    yield self.closed(client, session)
                else:
                    left.append((client, session))
        self.keep(left, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Closes all sessions of the group that are due; the first deadline may be later in the watermark's millisecond."""
        (stored, timer), now = self.stored(), timerValues.getCurrentWatermarkInMs()
        left = []
        for client, parts in stored.items():
            for part in parts:
                if self.due(part):
                    yield self.closed(client, part)
                else:
                    left.append((client, part))
        # the timer that fires is deleted by Spark
        self.keep(left, timer if timer is not None and timer >= now else None, now)

    def close(self) -> None:
        pass


def stream_sessions(rows: DataFrame, *, gap_us: int, late_hours: int, floors: list[int | None], slots: int) -> DataFrame:
    """Closed sessions of a stream of ROW rows; floors: W of the batches so far, the one to come included; slots: groups of clients."""
    before = floors[-2] if len(floors) > 1 else None
    rows = rows.withWatermark("ts", f"{late_hours} hours")
    if before is not None:
        rows = rows.where(F.col("us") >= before)
    slot = F.pmod(F.xxhash64("client_id"), F.lit(slots)).alias("slot")
    packed = rows.select(slot, "client_id", "us", "crc").mapInArrow(joiner(gap_us), "slot long, packed binary")
    return packed.groupBy("slot").transformWithState(Sessions(gap_us, floors), CLOSED, "Append", "EventTime")


def micros(column: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column.cast("timestamp_ntz"))


def once(clicks: DataFrame, id_col: str, client_col: str, time_col: str, arrival_col: str) -> DataFrame:
    """click_id, arrived, us, client_id (all long): each id once."""
    rows = clicks.select(F.col(id_col).cast("long").alias("click_id"), micros(F.col(arrival_col)).alias("arrived"), micros(F.col(time_col)).alias("us"), F.col(client_col).cast("long").alias("client_id")).dropna(subset=["click_id", "us", "client_id"])
    return rows.groupBy("click_id").agg(F.min(F.struct("arrived", "us", "client_id")).alias("row")).select("click_id", "row.*")


class Folder:
    """A new folder of a call, with what Hadoop's file system does in it."""

    def __init__(self, spark: SparkSession) -> None:
        self.path = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
        self.of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.of(self.at(name)))

    def move(self, name: str, to: str) -> bool:
        """Move a folder, if it is there."""
        return self.fs.exists(self.of(self.at(name))) and self.fs.rename(self.of(self.at(name)), self.of(self.at(to)))

    def drop(self, name: str) -> None:
        self.fs.delete(self.of(self.at(name)), True)


def close_sessions(clicks: DataFrame, *, batches: int = 8, gap_minutes: int = 30, late_hours: int = 240, id_col: str = "click_id", client_col: str = "client_id", time_col: str = "ts", arrival_col: str = "arrived_at", group_rows: int = 4096, store_rows: int = 65536) -> DataFrame:
    """client_id, first_us, last_us, n_clicks, ids_crc32, n_merges, close_batch of every session.

    The rows are cut by arrival into batches, every third client and hour a batch
    late, and fed one batch a start to a query on one checkpoint.
    """
    spark, gap, late = clicks.sparkSession, gap_minutes * MINUTE_US, late_hours * HOUR_US
    folder, own = Folder(spark), spark.newSession()
    for key, value in CONF.items():
        own.conf.set(key, value)
    # a client's rows stand together, those of a hot one in several tasks
    once(clicks, id_col, client_col, time_col, arrival_col).hint("rebalance", "client_id").write.parquet(folder.at("rows"))
    rows = spark.read.schema("click_id long, arrived long, us long, client_id long").parquet(folder.at("rows"))
    hour = lambda c: F.floor(F.col(c) / F.lit(HOUR_US))
    low, high, count = rows.agg(F.min(hour("arrived")), F.max(hour("arrived")), F.count(F.lit(1))).first()
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), count // store_rows + 1)
    own.conf.set("spark.sql.shuffle.partitions", stores)
    share = F.floor(F.lit(batches) * (hour("arrived") - F.lit(low)) / F.lit((high or 0) - (low or 0) + 1)) if low is not None else F.lit(0)
    later = (F.crc32(F.concat_ws(":", F.col("client_id").cast("string"), hour("us").cast("string")).cast("binary")) % 3 == 0) & F.col("arrived").isNotNull()
    batch = F.least(F.coalesce(share, F.lit(0)) + later.cast("int"), F.lit(batches - 1)).cast("int")
    fed = rows.select("client_id", "us", F.timestamp_micros("us").alias("ts"), F.crc32(F.col("click_id").cast("string").cast("binary")).alias("crc"), batch.alias("batch"))
    fed.sortWithinPartitions("batch", "client_id").write.partitionBy("batch").parquet(folder.at("staged"))
    tops = dict(spark.read.schema(f"{ROW}, batch int").parquet(folder.at("staged")).groupBy("batch").agg(F.max("us")).collect())  # a row a batch
    folder.make("fed")
    floors: list[int | None] = []
    for b in range(batches):
        top = max((t for k, t in tops.items() if k <= b), default=None)
        floors.append(None if top is None else top - late)
        if not folder.move(f"staged/batch={b}", f"fed/{b}"):
            continue
        stream = own.readStream.schema(ROW).option("recursiveFileLookup", "true").parquet(folder.at("fed"))
        query = stream_sessions(stream, gap_us=gap, late_hours=late_hours, floors=floors, slots=max(count // group_rows, 1)).writeStream.format("parquet").option("path", folder.at("closed")).option("checkpointLocation", folder.at("checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
    folder.drop("rows")
    if not tops:
        return spark.createDataFrame([], CLOSED)
    closed = spark.read.schema(CLOSED).parquet(folder.at("closed"))
    left = spark.read.format("statestore").option("path", folder.at("checkpoint")).option("stateVarName", "open").load()
    last = F.col("list_element.last")
    ends = F.coalesce(*(F.when(last + F.lit(gap) < F.lit(w), F.lit(b)) for b, w in enumerate(floors) if w is not None), F.lit(batches))
    open_ones = left.select(F.col("list_element.client").alias("client_id"), F.col("list_element.first").alias("first_us"), last.alias("last_us"), F.col("list_element.n").alias("n_clicks"), F.col("list_element.crc").alias("ids_crc32"), F.col("list_element.merges").alias("n_merges"), ends.cast("long").alias("close_batch"))
    return closed.unionByName(open_ones)


#: crc32 of an ASCII text, by its table of steps
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: xor(a >> 8, steps[1 + (xor(a, c) & 255)])), 4294967295::BIGINT)"""

SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS steps
), told AS (
  SELECT click_id, client_id, epoch_us(ts) AS us, epoch_us(arrived_at) // 3600000000 AS h, row_number() OVER (PARTITION BY click_id ORDER BY arrived_at NULLS FIRST, ts, client_id) AS copy
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
), ranged AS (
  SELECT *, min(h) OVER () AS lo, max(h) OVER () AS hi FROM told WHERE copy = 1
), dealt AS (
  SELECT client_id, us, <ids> AS crc,
    least(7, coalesce(8 * (h - lo) // (hi - lo + 1), 0) + CASE WHEN h IS NOT NULL AND <hours> % 3 = 0 THEN 1 ELSE 0 END) AS b
  FROM ranged CROSS JOIN crc
), tops AS (
  SELECT n.b, max(d.us) - 864000000000 AS w FROM range(8) n(b) LEFT JOIN (SELECT b, max(us) AS us FROM dealt GROUP BY b) d ON d.b <= n.b GROUP BY n.b
), kept AS (
  SELECT d.* FROM dealt d LEFT JOIN tops w ON w.b = d.b - 1 WHERE w.w IS NULL OR d.us >= w.w
), seen AS (
  SELECT n.b AS upto, k.client_id, k.us, k.crc, k.b, CASE WHEN k.us - lag(k.us) OVER (PARTITION BY n.b, k.client_id ORDER BY k.us) <= 1800000000 THEN 0 ELSE 1 END AS fresh
  FROM kept k JOIN range(8) n(b) ON k.b <= n.b
), cut AS (
  SELECT *, sum(fresh) OVER (PARTITION BY upto, client_id ORDER BY us, fresh DESC ROWS UNBOUNDED PRECEDING) AS part FROM seen
), parts AS (
  SELECT upto, client_id, part, min(us) AS first_us, max(us) AS last_us, count(*) AS n, sum(crc) AS crc, min(b) = upto AS born FROM cut GROUP BY upto, client_id, part
), sessions AS (
  SELECT client_id, first_us, last_us, n, crc FROM parts WHERE upto = 7
), births AS (
  SELECT s.client_id, s.first_us, count(*) AS n FROM sessions s JOIN parts p ON p.client_id = s.client_id AND p.born AND p.first_us BETWEEN s.first_us AND s.last_us GROUP BY ALL
)
SELECT s.client_id::BIGINT AS client_id, s.first_us::BIGINT AS first_us, s.last_us::BIGINT AS last_us, s.n::BIGINT AS n_clicks, s.crc::BIGINT AS ids_crc32, (b.n - 1)::BIGINT AS n_merges,
  coalesce((SELECT min(w.b) FROM tops w WHERE w.w > s.last_us + 1800000000), 8)::BIGINT AS close_batch
FROM sessions s JOIN births b ON b.client_id = s.client_id AND b.first_us = s.first_us
""".replace("<ids>", CRC_SQL.format(text="click_id::VARCHAR")).replace("<hours>", CRC_SQL.format(text="client_id::VARCHAR || ':' || (us // 3600000000)::VARCHAR"))
