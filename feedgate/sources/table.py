"""The record table as a folder: a base, and the changes committed since.

``<path>/base/v=<n>/``     table as of commit n, by source and collection, sorted by seq; a base marked
                           ``_partial`` holds the collections that changed, the others stay in the one before
``<path>/log/commit=<n>/`` rows written by commit n, one per changed key

A folder counts once its ``_SUCCESS`` marker exists. A commit is written aside, with its reports, and
moved into place as a whole, so a reader sees all of it or nothing. Commits are numbered by the
table. A commit made from a micro-batch carries that batch's name inside, and a batch that finds its
name has been committed already. There is one writer at a time.

A commit writes what changed and nothing else. Readers lay the newest logged row per key over
the base; ``compact`` writes a new base when the log has grown, and ``expire`` removes what no
reader needs any more.

``<path>/consumers/``      one marker per consumer: its name, the commit it has read up to, its lease

Consumers that follow the feed register how far they have read, for a time. The lowest commit read by
a consumer whose lease runs is the low watermark: neither a commit behind it nor a tombstone
that came after it is removed. What has been removed is recorded first, and a read that would need it
raises :class:`Expired` instead of returning fewer rows.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedgate.operators.counters import TOTALS, OutcomeCounter
from feedgate.operators.gates import sized
from feedgate.operators.indexing import with_index_columns
from feedgate.operators.merge import KEY
from feedgate.operators.replica import newest
from feedgate.plans.apply import RECORD
from feedgate.sources.scratch import delete, file_system
from feedgate.spec import SpecSet


#: How long a consumer's place is kept for it, unless it says otherwise.
LEASE_SECONDS = 7 * 24 * 3600

_OUTCOME_TOTALS = "outcome_totals"
_NAME = re.compile(r"[A-Za-z0-9._]+")
_CONSUMER = re.compile(r"/(?P<name>[A-Za-z0-9._]+)@(?P<commit>\d+)-(?P<until>\d+)$")


class Expired(LookupError):
    """What was asked for has been removed: start again from the current table."""


@dataclass(frozen=True)
class Consumer:
    name: str
    commit: int
    """The last commit it has read."""
    until: int
    """When its lease ends, in milliseconds since 1970."""


class RecordTable:
    def __init__(self, spark: SparkSession, path: str, specs: SpecSet, row_group_bytes: int | None = None):
        """``row_group_bytes`` sets the size of the base's row groups, of which reads skip whole ones."""
        self.spark, self.path, self.specs, self.row_group_bytes = spark, path.rstrip("/"), specs, row_group_bytes
        empty = spark.createDataFrame([], RECORD)
        self.schema: T.StructType = with_index_columns(empty, specs).schema

    # -- what has been committed

    def _found(self, pattern: str, taken: str) -> list[int]:
        """The numbers that ``taken`` matches in the paths of a pattern."""
        path, system = file_system(self.spark, f"{self.path}/{pattern}")
        paths = [str(found.getPath()) for found in system.globStatus(path) or []]
        return sorted(int(m.group(1)) for m in (re.search(taken, p) for p in paths) if m)

    def commits(self) -> list[int]:
        """Numbers of the commits in the log."""
        return self._found("log/commit=*/_SUCCESS", r"commit=(\d+)/_SUCCESS$")

    def bases(self) -> list[int]:
        return self._found("base/v=*/_SUCCESS", r"v=(\d+)/_SUCCESS$")

    def last_commit(self) -> int:
        return max([0, *self.commits(), *self.bases()])

    def committed(self, stream: str, batch: int) -> int | None:
        """The commit a micro-batch of a stream was made into, if there is one."""
        found = self._found(f"log/commit=*/_batch-{stream}-{batch}", r"commit=(\d+)/_batch-")
        return found[0] if found else None

    # -- reading

    def _log(self, after: int, upto: int) -> DataFrame | None:
        wanted = [n for n in self.commits() if after < n <= upto]
        if not wanted:
            return None
        paths = [f"{self.path}/log/commit={n}" for n in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def expired(self) -> int:
        """The last commit that has been removed, 0 if none has."""
        return max([0, *self._found("log/_expired-*", r"_expired-(\d+)-\d+$")])

    def purged(self) -> int:
        """The position up to which tombstones have been removed, 0 if none has."""
        return max([0, *self._found("base/v=*/_purged-*", r"_purged-(\d+)$")])

    def _known(self, upto: int | None) -> int:
        last = self.last_commit()
        if upto is not None and upto > last:
            raise ValueError(f"there is no commit {upto}, the last one is {last}")
        return last if upto is None else upto

    def feed(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Rows as committed, possibly several per key; raises if some of them have been expired."""
        upto = self._known(upto)
        if after < upto and after < self.expired():
            raise Expired(f"commits up to {self.expired()} have been removed, the feed cannot go on after {after}")
        log = self._log(after, upto)
        return self.spark.createDataFrame([], self.schema) if log is None else log

    def changed_since(self, seq: int) -> DataFrame:
        """Current rows above a position, deletions included; raises if deletions above it have been purged."""
        if seq < self.purged():
            raise Expired(f"deletions up to position {self.purged()} have been removed, changes after {seq} are incomplete")
        return self.read().filter(F.col("seq") > seq)

    def read(self, upto: int | None = None, collections: Iterable[str] | None = None) -> DataFrame:
        """The table as of a commit, the last one by default; of some collections, if they are named.

        Keys logged since the base hide their base row. They are broadcast if their bytes allow it, so
        that reading a large base moves none of it. Only folders of named collections are scanned. A
        version whose base and commits are not all there any more raises.
        """
        upto = self._known(upto)
        base_at = max([n for n in self.bases() if n <= upto], default=0)
        if base_at < min(upto, self.expired()):
            raise Expired(f"version {upto} has been removed: commits up to {self.expired()} are gone")
        wanted = F.lit(True) if collections is None else F.col("collection").isin(list(collections))
        log = self._log(base_at, upto)
        log = None if log is None else log.filter(wanted)
        current = self.spark.createDataFrame([], self.schema) if log is None else newest(log)
        current = current.select(self.schema.names)
        if not base_at:
            return current
        base = self._base(base_at).filter(wanted)
        if log is None:
            return base
        changed = sized(log.select(*KEY).distinct(), "logged")
        return base.join(changed, KEY, "left_anti").select(self.schema.names).unionByName(current)

    def _places(self, base: int) -> dict[str, int]:
        """``source=…/collection=…`` of a base, and the version whose folder has it: the newest up to the last full one."""
        partial = set(self._found("base/v=*/_partial", r"v=(\d+)/_partial$"))
        chain = [n for n in self.bases() if n <= base]
        first = max((n for n in chain if n not in partial), default=0)
        path, system = file_system(self.spark, f"{self.path}/base/v=*/source=*/collection=*")
        found: dict[str, int] = {}
        for status in system.globStatus(path) or []:
            version, place = re.search(r"/v=(\d+)/(source=[^/]+/collection=[^/]+)$", str(status.getPath())).groups()
            if first <= int(version) <= base and int(version) in chain:
                found[place] = max(found.get(place, 0), int(version))
        return found

    def _base(self, number: int) -> DataFrame:
        """The rows of a base, each collection from the version that wrote it last."""
        versions: dict[int, list[str]] = {}
        for place, version in sorted(self._places(number).items()):
            versions.setdefault(version, []).append(place)
        rows = self.spark.createDataFrame([], self.schema)
        if set(versions) == {number} and not self._found(f"base/v={number}/_partial", r"v=(\d+)/"):
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/base/v={number}")
        for version, places in versions.items():
            root = f"{self.path}/base/v={version}"
            reader = self.spark.read.schema(self.schema).option("basePath", root)
            rows = rows.unionByName(reader.parquet(*(f"{root}/{place}" for place in places)).select(self.schema.names))
        return rows

    def max_seq(self) -> int:
        """Highest position ever given out; every commit and base has it in a name, so none is read."""
        logged = self._found("log/commit=*/_seq-*", r"_seq-(\d+)$")
        return max([0, *logged, *self._found("base/v=*/_seq-*", r"_seq-(\d+)$")])

    def reports(self, kind: str) -> DataFrame | None:
        """What runs reported next to their commits, for example ``rejects`` or ``results``."""
        path, system = file_system(self.spark, f"{self.path}/log/commit=*/_reports/{kind}/_SUCCESS")
        found = [str(f.getPath()).removesuffix("/_SUCCESS") for f in system.globStatus(path) or []]
        return self.spark.read.parquet(*found) if found else None

    def outcome_totals(self) -> DataFrame:
        """commit, collection, outcome, total: what each commit in the log counted while it was written."""
        kept = self.reports(_OUTCOME_TOTALS)
        if kept is None:
            return self.spark.createDataFrame([], f"commit long, {TOTALS}")
        number = F.regexp_extract("_metadata.file_path", r"/commit=(\d+)/", 1).cast("long")
        return kept.select(number.alias("commit"), "collection", "outcome", "total")

    def last_report(self, stream: str, kind: str) -> DataFrame | None:
        """What a stream's last micro-batch reported next to its commit."""
        found = self._found(f"log/commit=*/_batch-{stream}-*", r"commit=(\d+)/_batch-")
        path = f"{self.path}/log/commit={max(found, default=0)}/_reports/{kind}"
        there, system = file_system(self.spark, f"{path}/_SUCCESS")
        return self.spark.read.parquet(path) if found and system.exists(there) else None

    # -- writing

    def _mark(self, folder: str, name: str) -> None:
        path, system = file_system(self.spark, f"{folder}/{name}")
        system.create(path).close()

    def commit(
        self,
        changes: DataFrame,
        *,
        batch: tuple[str, int] | None = None,
        reports: dict[str, DataFrame] | None = None,
        counter: OutcomeCounter | None = None,
    ) -> int:
        """Append one run's changes and reports as the next commit.

        ``batch`` names the stream and micro-batch they come from; one that has been committed is left
        as it is, and its number returned. What ``counter`` saw while a report it watches was written is
        kept with the commit, for :meth:`outcome_totals`.
        """
        if batch is not None and (done := self.committed(*batch)) is not None:
            return done
        number, aside = self.last_commit() + 1, f"{self.path}/staging/{uuid.uuid4().hex}"
        changes.select(self.schema.names).write.parquet(aside)
        for kind, rows in (reports or {}).items():
            rows.write.parquet(f"{aside}/_reports/{kind}")
        if counter is not None:
            totals = self.spark.createDataFrame(counter.totals(), TOTALS).coalesce(1)
            totals.write.parquet(f"{aside}/_reports/{_OUTCOME_TOTALS}")
        written = self.spark.read.schema(self.schema).parquet(aside)
        highest = written.agg(F.max("seq")).first()[0]
        self._mark(aside, f"_seq-{max(highest or 0, self.max_seq())}")
        if batch is not None:
            self._mark(aside, f"_batch-{batch[0]}-{batch[1]}")
        self._move(aside, f"{self.path}/log/commit={number}")
        return number

    def _move(self, source: str, target: str) -> None:
        start, system = file_system(self.spark, source)
        end, _ = file_system(self.spark, target)
        system.mkdirs(end.getParent())
        if not system.rename(start, end):
            raise OSError(f"{source} could not be moved to {target}")

    def _write_base(self, rows: DataFrame, path: str) -> None:
        """Files by source and collection, with Bloom filters of the ids and of every filterable field.

        A row group covers a stretch of the feed, so a read after a position skips by its bounds; ids and
        field values are spread over all of them, and a read for one of these skips by the filters.
        """
        writer = rows.write.partitionBy("source", "collection").option("parquet.bloom.filter.adaptive.enabled", "true")
        for name in ("id", *(n for n in self.schema.names if n.startswith("idx_"))):
            if not isinstance(self.schema[name].dataType, T.BooleanType):
                writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        if self.row_group_bytes:
            writer = writer.option("parquet.block.size", str(self.row_group_bytes))
        writer.parquet(path)

    def compact(self) -> int:
        """Write the current state of the collections that changed since the last base as a new one.

        Collections without a change keep their files: the new base is marked as partial and read together
        with those before it. Rows are spread by position within collections, so a large collection becomes
        many files of similar size, each covering a stretch of the feed.
        """
        upto = self.last_commit()
        before = max([n for n in self.bases() if n <= upto], default=0)
        if before == upto:
            return upto
        order, aside = ["source", "collection", "seq"], f"{self.path}/staging/{uuid.uuid4().hex}"
        log = self._log(before, upto)
        # One row per collection.
        touched = [] if not before or log is None else log.select("source", "collection").distinct().collect()
        rows = self.read(upto, [row.collection for row in touched] if before else None)
        if before:
            pairs = [(F.col("source") == row.source) & (F.col("collection") == row.collection) for row in touched]
            rows = rows.filter(reduce(or_, pairs, F.lit(False)))
        self._write_base(rows.repartitionByRange(*order).sortWithinPartitions(*order), aside)
        self._mark(aside, f"_seq-{self.max_seq()}")
        written = [f"source={row.source}/collection={row.collection}" for row in touched]
        if before and set(self._places(before)) - set(written):
            self._mark(aside, "_partial")
            # A collection that has no rows left says so, or the base before would be read for it.
            for place in written:
                self._mark(f"{aside}/{place}", "_touched")
        self._move(aside, f"{self.path}/base/v={upto}")
        return upto

    def _waited_with(self) -> list[int]:
        """Last commits of streams that left operations waiting."""
        path, system = file_system(self.spark, f"{self.path}/log/commit=*/_batch-*")
        last: dict[str, int] = {}
        for status in system.globStatus(path) or []:
            number, stream = re.search(r"commit=(\d+)/_batch-(.+)-\d+$", str(status.getPath())).groups()
            last[stream] = max(last.get(stream, 0), int(number))
        return [n for n in last.values() if self._found(f"log/commit={n}/_reports/waiting", r"commit=(\d+)/_reports")]

    # -- consumers

    def consumers(self) -> dict[str, Consumer]:
        """Registered consumers by name, whether their leases run or not."""
        path, system = file_system(self.spark, f"{self.path}/consumers/*")
        found: dict[str, Consumer] = {}
        for status in system.globStatus(path) or []:
            match = _CONSUMER.search(str(status.getPath()))
            if match:
                one = Consumer(match["name"], int(match["commit"]), int(match["until"]))
                # A marker is written before the one it replaces is removed: the lower commit is safe.
                known = found.get(one.name)
                commit = one.commit if known is None else min(one.commit, known.commit)
                found[one.name] = Consumer(one.name, commit, max(one.until, known.until if known else 0))
        return found

    def register(self, name: str, commit: int, lease_seconds: float = LEASE_SECONDS, now: float | None = None) -> Consumer:
        """Say that a consumer has read up to a commit, and keep what follows for it while its lease runs.

        To be called after each stretch of the feed; each call begins the lease anew. A commit whose
        successors have been removed already raises.
        """
        if not _NAME.fullmatch(name):
            raise ValueError(f"no name for a consumer: {name!r}")
        if commit < self.expired():
            raise Expired(f"commits up to {self.expired()} have been removed, {name} cannot go on after {commit}")
        self._known(commit)
        until = int(((time.time() if now is None else now) + lease_seconds) * 1000)
        before = self._markers(name)
        marker = f"{name}@{commit}-{until}"
        self._mark(f"{self.path}/consumers", marker)
        for path in before:
            if not path.endswith(f"/{marker}"):
                delete(self.spark, path)
        return Consumer(name, commit, until)

    def unregister(self, name: str) -> None:
        for path in self._markers(name):
            delete(self.spark, path)

    def _markers(self, name: str) -> list[str]:
        path, system = file_system(self.spark, f"{self.path}/consumers/{name}@*")
        return [str(status.getPath()) for status in system.globStatus(path) or []]

    def low_watermark(self, now: float | None = None) -> int:
        """The lowest commit a consumer whose lease runs has read; the last commit if there is none."""
        at = (time.time() if now is None else now) * 1000
        return min([self.last_commit(), *(c.commit for c in self.consumers().values() if c.until > at)])

    def seq_of(self, commit: int) -> int:
        """The highest position as of a commit."""
        if commit < self.expired():
            raise Expired(f"commit {commit} has been removed")
        positions = [0]
        for pattern in ("log/commit=*/_seq-*", "base/v=*/_seq-*", "log/_expired-*"):
            path, system = file_system(self.spark, f"{self.path}/{pattern}")
            for status in system.globStatus(path) or []:
                number, seq = re.search(r"[=-](\d+)(?:/_seq)?-(\d+)$", str(status.getPath())).groups()
                if int(number) <= commit:
                    positions.append(int(seq))
        return max(positions)

    # -- removing

    def expire(self, keep_bases: int = 2, keep_commits: int = 1000, now: float | None = None) -> None:
        """Remove bases but the newest, and commits that a base covers but the newest, and what crashed.

        Commits after the low watermark stay, whatever their number: some consumer has yet to read them.
        The newest commits stay, so a stream's last micro-batch still finds its name, as does every commit
        from the last one of a stream on with which operations wait for the rest of their batch.
        """
        bases, commits = self.bases(), self.commits()
        covered = min(max(bases, default=0), self.low_watermark(now), *(n - 1 for n in self._waited_with()))
        doomed = [number for number in commits[: -max(1, keep_commits)] if number <= covered]
        if doomed:
            # Recorded before anything goes: readers that come in between are refused, not misled.
            self._mark(f"{self.path}/log", f"_expired-{max(doomed)}-{self.seq_of(max(doomed))}")
        kept = bases[-max(1, keep_bases) :]
        needed = {*kept, *(version for number in kept for version in self._places(number).values())}
        # The full base that a partial one goes back to stays, or later ones would be read past it.
        for number in bases:
            if number not in needed and not self._between(number, kept):
                delete(self.spark, f"{self.path}/base/v={number}")
        for number in doomed:
            delete(self.spark, f"{self.path}/log/commit={number}")
        delete(self.spark, f"{self.path}/staging")

    def _between(self, number: int, kept: list[int]) -> bool:
        """Whether a base is the full one that the oldest kept base, being partial, is read from."""
        partial = set(self._found("base/v=*/_partial", r"v=(\d+)/_partial$"))
        full = [n for n in self.bases() if n not in partial]
        return any(number == max((n for n in full if n <= k), default=0) for k in kept)

    def purge_tombstones(self, upto_seq: int | None = None, now: float | None = None) -> int:
        """Write a base without the tombstones every consumer has read, or of them those up to a position.

        A position that a consumer whose lease runs has yet to reach is refused. A later delete of such a
        record is unchanged, as one of a record that never was.
        """
        safe = self.seq_of(self.low_watermark(now))
        if upto_seq is None:
            upto_seq = safe
        elif upto_seq > safe and safe < self.max_seq():
            late = [c.name for c in self.consumers().values() if c.commit == self.low_watermark(now)]
            raise ValueError(f"deletions after position {safe} are still to be read by {', '.join(late)}")
        upto_seq = min(upto_seq, self.max_seq())
        upto = self.last_commit() + 1
        order, aside = ["source", "collection", "seq"], f"{self.path}/staging/{uuid.uuid4().hex}"
        kept = self.read().filter(F.col("deleted_at").isNull() | (F.col("seq") > upto_seq))
        rows = kept.repartitionByRange(*order).sortWithinPartitions(*order)
        self._write_base(rows, aside)
        self._mark(aside, f"_seq-{self.max_seq()}")
        self._mark(aside, f"_purged-{max(upto_seq, self.purged())}")
        self._move(aside, f"{self.path}/base/v={upto}")
        return upto
