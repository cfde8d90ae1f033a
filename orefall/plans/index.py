"""The stored index: segments of nodes, parents, postings, block bounds and lengths, tombstones, and numbered manifests."""

from __future__ import annotations

import copy
import hashlib
import json
import threading
import time
import uuid
from collections import OrderedDict, defaultdict
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.errors import CodedError
from orefall.operators import lexical, segmentation

PARTS = ("nodes", "parents", "postings", "blocks", "lengths", "totals")
#: Columns by which searches are scoped, kept beside lengths as far as the nodes have them.
SCOPES = ("visibility", "owner_id", "source_name", "filename", "document_id")
#: The scopes that a block of postings never mixes, by which totals are kept; kept beside postings, too.
SEEN_BY = ("visibility", "owner_id")

POINTER = "current-"
#: Nodes that share a block of a term's postings, about.
BLOCK = 64
#: Segments of about one size, a power of TIER, that are merged once there are TIER of them.
TIER = 4


@dataclass(frozen=True)
class Signature:
    model: str
    dimensions: int
    endpoint: str = ""


@dataclass(frozen=True)
class Manifest:
    """What one version consists of: segments with their number of nodes, and folders of tombstones.

    applied: the last batch of each stream that it holds. number: of its pointer.
    """

    version: str
    segments: dict[str, int]
    tombstones: list[str] = field(default_factory=list)
    applied: dict[str, int] = field(default_factory=dict)
    number: int = 0

    @property
    def folders(self) -> set[str]:
        return {*self.segments, *self.tombstones}


class Index:
    """A folder with a sub-folder for each segment and each set of tombstones, and numbered manifests of which the highest is current.

    Adding documents writes one new segment, deleting some writes tombstones alone, and merging writes segments of about one size as one;
    no other folder is touched. Statistics are sums over segments, less what tombstones take away, so that any history gives
    the answers of a full rebuild. All folders of a version are written before its manifest is renamed into a place that is still
    free: readers see a version whole or not at all, a failed write leaves the old one current, and of two writers that began
    from the same version the second is refused. That needs a store whose rename refuses an existing target in one step,
    as HDFS does; on others, and on a local disk, let one writer at a time work. The version before stays for those who read it; folders that
    neither has are removed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._read: tuple[str | None, dict[str, DataFrame]] = (None, {})
        self._file = jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests

    def _read_json(self, name: str) -> dict | None:
        p = self._file(f"{self.path}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_json(self, name: str, value: dict) -> None:
        """Written aside, then renamed into a place that must be free."""
        tmp, final = self._file(f"{self.path}/.{name}-{uuid.uuid4().hex}"), self._file(f"{self.path}/{name}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(tmp, final):
            self._fs.delete(tmp, False)
            raise CodedError("publish_failed", f"{name} could not be put into place", 500)

    def _names(self, begin: str) -> list[str]:
        if not self._fs.exists(self._file(self.path)):
            return []
        return sorted(n for f in self._fs.listStatus(self._file(self.path)) if (n := f.getPath().getName()).startswith(begin))

    def _manifest(self, name: str) -> Manifest | None:
        held = self._read_json(name)
        return Manifest(**held, number=int(name.removeprefix(POINTER))) if held else None

    @property
    def manifest(self) -> Manifest | None:
        names = self._names(POINTER)
        return self._manifest(names[-1]) if names else None

    @property
    def version(self) -> str | None:
        now = self.manifest
        return now.version if now else None

    def _current(self) -> Manifest:
        now = self.manifest
        if now is None:
            raise CodedError("empty_index", "nothing has been published", 404)
        return now

    def _commit(self, before: Manifest | None, version: str, segments: dict[str, int], tombstones: list[str], applied: dict[str, int] | None = None) -> str:
        """Make these folders the version after `before`; refused if there is another one by now."""
        number = before.number + 1 if before else 1
        done = (before.applied if before else {}) | (applied or {})
        self.write_json(f"{POINTER}{number:012}", {"version": version, "segments": segments, "tombstones": tombstones, "applied": done})
        kept = {*segments, *tombstones} | (before.folders if before else set())
        for name in self._names(POINTER):
            if int(name.removeprefix(POINTER)) < number - 1:
                old = self._manifest(name)
                for gone in (old.folders if old else set()) - kept:
                    self._fs.delete(self._file(f"{self.path}/{gone}"), True)
                self._fs.delete(self._file(f"{self.path}/{name}"), False)
        return version

    def applied(self, stream: str) -> int:
        """The last batch of a stream that the current version holds, -1 without any."""
        now = self.manifest
        return now.applied.get(stream, -1) if now else -1

    def sweep(self) -> list[str]:
        """Remove folders that neither the current version nor the one before names: what failed writes left. For the only writer."""
        kept = set().union(*[m.folders for n in self._names(POINTER)[-2:] if (m := self._manifest(n))])
        left = [n for n in [*self._names("v-"), *self._names("t-")] if n not in kept]
        for name in left:
            self._fs.delete(self._file(f"{self.path}/{name}"), True)
        return left

    def check(self, own: Signature, adopt: bool = False) -> None:
        """Fails on another model's index, and on data without a signature unless it is adopted."""
        known = self._read_json("signature.json")
        if known is None and self.version and not adopt:
            raise CodedError("unsigned_index", "the index has data but no signature; adopt it explicitly", 409)
        if known is not None and known != asdict(own):
            raise CodedError("index_mismatch", f"the index was built with {known}", 409)
        if known is None:
            self.write_json("signature.json", asdict(own))

    # ---- reading

    def _table(self, folders: list[str], name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}/{name}" for f in folders])

    def _of(self, now: Manifest, name: str) -> DataFrame:
        """A table of the version, read once for each version, so that its schema is too."""
        if self._read[0] != now.version:
            self._read = (now.version, {})
        if name not in self._read[1]:
            self._read[1][name] = self._table(now.tombstones, "dead") if name == "dead" else self._table(list(now.segments), name)
        return self._read[1][name]

    def raw(self, name: str) -> DataFrame:
        """A part with the rows that tombstones take away."""
        return self._of(self._current(), name)

    def dead(self) -> DataFrame | None:
        """The lengths rows that tombstones take away; None without any."""
        now = self._current()
        return self._of(now, "dead") if now.tombstones else None

    def part(self, name: str) -> DataFrame:
        """The live rows of a part of the current version."""
        now = self._current()
        rows, dead = self._of(now, name), self.dead()
        if dead is None or name == "blocks":  # bounds hold for fewer nodes as well
            return rows
        if name == "parents":
            return rows.join(self.part("nodes").select("parent_id").distinct(), "parent_id", "left_semi")
        if name == "totals":
            less = dead.groupBy(*[c for c in SEEN_BY if c in dead.columns]).agg((-F.count("*")).alias("nodes"), (-F.sum("term_count")).alias("terms"))
            return rows.drop("segment").unionByName(less)
        return rows.join(dead.select("segment", "node_id"), ["segment", "node_id"], "left_anti")

    def postings_of(self, terms: list[str], name: str = "postings") -> DataFrame:
        """Postings (or blocks) of some terms; files and row groups without them are skipped by their statistics."""
        return self.part(name).where(F.col("term").isin(sorted(set(terms))))

    # ---- writing

    def _write(self, folder: str, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/{folder}/{name}")

    def _write_segment(self, parts: dict[str, DataFrame]) -> tuple[str, int]:
        """A folder of its own with all parts; blocks and totals follow from postings and lengths, and these from counts if they are given."""
        name = f"v-{uuid.uuid4().hex}"
        mark = F.lit(name).alias("segment")
        for part in ("nodes", "parents"):
            self._write(name, part, parts[part].drop("segment").select("*", mark))
        if "counts" in parts:  # texts are cut into terms once
            self._write(name, "counts", parts["counts"])
            counts = self._table([name], "counts")
            lengths, found = counts.drop("terms", "freqs"), counts.withColumnRenamed("term_count", "node_terms")
        else:
            lengths, found = parts["lengths"].drop("segment", "bucket"), parts["postings"]
        by = [c for c in SEEN_BY if c in lengths.columns]
        if not {"node_terms", *by} <= set(found.columns):
            found = found.select("node_id", "term", "freq").join(lengths.select("node_id", F.col("term_count").alias("node_terms"), *by), "node_id")

        def placed(rows: DataFrame, many: DataFrame) -> DataFrame:
            """Rows with their node's bucket, which follows from its key and the number of nodes of its scopes: postings meet no lengths."""
            several = F.pmod(F.xxhash64("node_id"), F.ceil(F.col("_n") / BLOCK))
            rows = rows.join(many, by) if by else rows.crossJoin(F.broadcast(many))  # without scopes, one row
            return rows.withColumn("bucket", F.xxhash64(*by, several)).drop("_n")

        self._write(name, "lengths", placed(lengths, lengths.groupBy(*by).agg(F.count("*").alias("_n"))).select("*", mark))
        self._write(name, "totals", self._table([name], "lengths").groupBy(*by).agg(F.count("*").alias("nodes"), F.sum("term_count").alias("terms")).select("*", mark))
        found = placed(found, self._table([name], "totals").select(*by, F.col("nodes").alias("_n")))
        if "counts" in parts:
            found = found.select("*", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("freqs").alias("freq"))))
        # A term's postings lie together, and files know their least and greatest term; a frequent one has several.
        found = found.select("node_id", "term", "freq", "node_terms", "bucket", *by).repartitionByRange(F.col("term"), F.col("bucket"))
        self._write(name, "postings", found.sortWithinPartitions("term", "bucket", "node_id").select("*", mark))
        self._write(name, "blocks", _blocks(self._table([name], "postings"), by).sortWithinPartitions("term", "bucket"))
        if "counts" in parts:
            self._fs.delete(self._file(f"{self.path}/{name}/counts"), True)
        return name, self._table([name], "nodes").count()

    def _write_dead(self, rows: DataFrame) -> list[str]:
        """A folder of tombstones; none where no row would be in it."""
        name = f"t-{uuid.uuid4().hex}"
        self._write(name, "dead", rows)
        if self._table([name], "dead").isEmpty():
            self._fs.delete(self._file(f"{self.path}/{name}"), True)
            return []
        return [name]

    def publish(self, parts: dict[str, DataFrame]) -> str:
        """One segment of nodes, parents, postings and lengths in place of everything."""
        before = self.manifest
        name, n = self._write_segment(parts)
        return self._commit(before, name, {name: n}, [])

    def _pieces(self, docs: DataFrame) -> DataFrame:
        """Child nodes of documents (document_id, source_name, owner_id, visibility, filename, text)."""
        chunks = segmentation.hierarchy(docs).join(docs.select("document_id", "source_name", "owner_id", "visibility"), "document_id")
        return chunks.withColumn("node_id", F.sha2(F.concat_ws("\0", F.col("document_id").cast("string"), F.col("ordinal").cast("string"), "content_hash"), 256))

    def build(self, docs: DataFrame) -> str:
        """Publish everything from documents; what was there before goes."""
        return self.publish(derived(self._pieces(docs)))

    def add(self, docs: DataFrame, applied: dict[str, int] | None = None) -> str:
        """Put documents beside the others, in place of their earlier forms: one new segment, and tombstones for what it replaces.

        applied: stream and batch that the version then holds; a batch that it holds already is left alone.
        """
        before = self.manifest
        if before and applied and all(before.applied.get(k, -1) >= v for k, v in applied.items()):
            return before.version
        dead = []
        if before:
            dead = self._write_dead(self.part("lengths").join(docs.select("document_id").distinct(), "document_id", "left_semi"))
        name, n = self._write_segment(derived(self._pieces(docs)))
        return self._commit(before, name, (before.segments if before else {}) | {name: n}, (before.tombstones if before else []) + dead, applied)

    def delete(self, gone: DataFrame, key: str = "document_id") -> str:
        """A version without the nodes of some documents, sources or ids, in all parts alike: tombstones alone are written."""
        before = self._current()
        dead = self._write_dead(self.part("lengths").join(gone.select(key).distinct(), key, "left_semi"))
        return self._commit(before, dead[0], before.segments, before.tombstones + dead) if dead else before.version

    def prune(self, registry: DataFrame, key: str = "document_id") -> str:
        """A version without the nodes whose document the registry does not have; all parts lose them in one commit."""
        before = self._current()
        dead = self._write_dead(self.part("lengths").join(registry.select(key).distinct(), key, "left_anti"))
        return self._commit(before, dead[0], before.segments, before.tombstones + dead) if dead else before.version

    def merge(self, everything: bool = False) -> str:
        """Live rows of TIER or more segments of about one size as one segment, from the smallest size on; or of all segments.

        Nothing is tokenised again. Tombstones go when no segment is left that they were written for.
        """
        before = self._current()
        tiers = defaultdict(list)
        for name, n in before.segments.items():
            tiers[0 if everything else max(n, 1).bit_length() // 2].append(name)
        chosen = next((v for _, v in sorted(tiers.items()) if len(v) >= (1 if everything else TIER)), None)
        if chosen is None or (len(before.segments) == 1 and not before.tombstones):
            return before.version
        dead = self.dead()

        def live(part: str) -> DataFrame:
            rows = self._of(before, part).where(F.col("segment").isin(chosen))
            return rows if dead is None else rows.join(dead.select("segment", "node_id"), ["segment", "node_id"], "left_anti")

        parents = self._of(before, "parents").where(F.col("segment").isin(chosen)).join(live("nodes").select("segment", "parent_id").distinct(), ["segment", "parent_id"], "left_semi")
        name, n = self._write_segment({"nodes": live("nodes"), "parents": parents, "postings": live("postings"), "lengths": live("lengths")})
        rest = {k: v for k, v in before.segments.items() if k not in chosen}
        left = []
        if before.tombstones and rest:
            left = self._write_dead(dead.where(F.col("segment").isin(list(rest))))
        return self._commit(before, name, rest | {name: n}, left)

    def rebuild(self) -> str:
        """Everything again from the stored nodes."""
        return self.publish(derived(self.part("nodes").drop("segment")))


def derived(nodes: DataFrame) -> dict[str, DataFrame]:
    """The parts of nodes; those of their terms follow from counts."""
    return {"nodes": nodes, "parents": segmentation.parents(nodes), "counts": lexical.counts(nodes, [c for c in SCOPES if c in nodes.columns])}


def _blocks(postings: DataFrame, by: list[str]) -> DataFrame:
    """(segment, term, bucket, *by, n, most, shortest) of sorted postings, as they lie: a block that two batches share has two rows,
    whose numbers add up and whose bounds both hold."""
    named = ["segment", "term", "bucket", *by]

    def run(batches):
        for b in batches:
            g = pa.Table.from_batches([b]).group_by(named).aggregate([("freq", "count"), ("freq", "max"), ("node_terms", "min")])
            yield from g.select([*named, "freq_count", "freq_max", "node_terms_min"]).rename_columns([*named, "n", "most", "shortest"]).to_batches()

    kinds = ", ".join(f"`{c}` {postings.schema[c].dataType.simpleString()}" for c in named)
    return postings.select(*named, "freq", "node_terms").mapInArrow(run, f"{kinds}, n long, most long, shortest long")


class Cache:
    """Small answers by key for a while; the oldest use goes first. Answers are copied in and out."""

    def __init__(self, seconds: float = 60, entries: int = 256, clock=time.monotonic) -> None:
        self.seconds, self.entries, self.clock = seconds, entries, clock
        self._held: OrderedDict = OrderedDict()
        self._lock = threading.Lock()

    @staticmethod
    def key(user_id: str, is_admin: bool, version: str, query: str, **options) -> str:
        """Binds who asks, what the knowledge is, the normalised question and every option."""
        return hashlib.sha256(json.dumps([user_id, is_admin, version, " ".join(query.split()).casefold(), options], sort_keys=True, default=str).encode()).hexdigest()

    def get(self, key: str):
        with self._lock:
            at, value = self._held.get(key, (None, None))
            if at is None or self.clock() - at > self.seconds:
                self._held.pop(key, None)
                return None
            self._held.move_to_end(key)
            return copy.deepcopy(value)

    def put(self, key: str, value) -> None:
        with self._lock:
            self._held[key] = (self.clock(), copy.deepcopy(value))
            self._held.move_to_end(key)
            while len(self._held) > self.entries:
                self._held.popitem(last=False)


def knowledge_version(registry: DataFrame) -> str:
    """count:latest:sum of versions of the visible documents; changes with any of them."""
    r = registry.agg(F.count("*"), F.max("updated_at"), F.sum("version")).first()
    return ":".join(str(x) for x in r)


