"""Sources and the building of the canonical map and the merged modality tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAP_SCHEMA = "n long, frame_idx long, pts_time double"
#: Names under which sources give a column.
ALIASES = {
    "video_id": ["video_id", "vid", "video"],
    "text": ["text", "chunk", "transcript"],
    "frame_idx": ["frame_idx", "frame_id"],
    "pts_time": ["pts_time", "timestamp"],
    "global_id": ["global_id", "g", "row_id", "id"],
}


def unify(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Columns under their usual names; of several aliases the first that isn't null. Names are compared without case."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for name in wanted:
        found = [F.col(f"`{have[a]}`") for a in ALIASES.get(name, [name]) if a in have]
        out.append((F.coalesce(*found) if found else F.lit(None)).alias(name))
    return df.select(*out)


def read_map_csvs(spark: SparkSession, *roots: str) -> DataFrame:
    """(video_id, n, frame_idx, pts_time) of every CSV below the roots; the file's stem is the video id. Malformed rows fail."""
    rows = spark.read.schema(MAP_SCHEMA).option("header", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(list(roots))
    return rows.select(F.regexp_extract(F.input_file_name(), "([^/]+)\\.csv$", 1).alias("video_id"), F.input_file_name().alias("file"), "n", "frame_idx", "pts_time")


def repeated_videos(rows: DataFrame) -> DataFrame:
    """Videos that come from more than one file."""
    return rows.groupBy("video_id").agg(F.countDistinct("file").alias("files")).where("files > 1")


def canonical_map(rows: DataFrame) -> DataFrame:
    """(g, video_id, pack, kf_n, frame_idx, pts_time) of (video_id, n, frame_idx, pts_time).

    ``g`` is dense over (pack, video, n). It is made of a range sort, counts per partition and a running number inside
    each partition, so no single task numbers all rows.
    """
    base = rows.select("video_id", F.regexp_extract("video_id", "^([A-Z]\\d{2})", 1).alias("pack"), F.col("n").alias("kf_n"), "frame_idx", "pts_time")
    return dense_id(base, ["pack", "video_id", "kf_n"], "g").select("g", "video_id", "pack", "kf_n", "frame_idx", "pts_time")


def dense_id(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a number from 0 without holes in the given total order: a prefix sum over groups of the first order column, then within them."""
    head, rest = order[0], order[1:] or order
    sizes = df.groupBy(head).agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(W.orderBy(F.col(head).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = df.withColumn("_i", F.row_number().over(W.partitionBy(head).orderBy(*rest)) - 1)
    same = inner[head].eqNullSafe(starts[head])
    return inner.join(starts, same).select(*(inner[c] for c in df.columns), (F.col("_s") + F.col("_i")).cast("long").alias(name))


def resolve_frames(wanted: DataFrame, canonical: DataFrame) -> DataFrame:
    """(video_id, kf_n) requests with their frame and ``found``."""
    return wanted.join(canonical.select("video_id", "kf_n", "frame_idx", "pts_time", F.lit(True).alias("_f")), ["video_id", "kf_n"], "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def merge_by_priority(sources: list[tuple[DataFrame, str, int]], key: list[str]) -> DataFrame:
    """One row per key from the source with the lowest priority number, ties by provenance; missing columns are null."""
    rows = None
    for df, provenance, priority in sources:
        d = df.withColumn("provenance", F.lit(provenance)).withColumn("priority", F.lit(priority))
        rows = d if rows is None else rows.unionByName(d, allowMissingColumns=True)
    w = W.partitionBy(*key).orderBy("priority", "provenance")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fill_mapping(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """Null ``kf_n`` and ``frame_idx`` filled from the nearest keyframe of the middle of the chunk, ties to the earlier; others stay."""
    from keyreel.operators.temporal import nearest_row

    mid = rows.withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    near = nearest_row(mid, canonical.withColumnRenamed("pts_time", "_c_time").select("video_id", "_c_time", "kf_n", "frame_idx"), on="video_id", time="_mid", right_time="_c_time", payload=["kf_n", "frame_idx"])
    return near.withColumn("kf_n", F.coalesce("kf_n", "near_kf_n")).withColumn("frame_idx", F.coalesce("frame_idx", "near_frame_idx")).drop("_mid", "near_kf_n", "near_frame_idx")


def merged_speech(packs: list[DataFrame]) -> DataFrame:
    """Packs united under one schema, rows without a mapping dropped, ``pts_time`` from the middle where absent, chunk numbers and dense row ids."""
    cols = ["video_id", "text", "start", "end", "kf_n", "frame_idx", "pts_time"]
    rows = None
    for p in packs:
        d = unify(p, cols)
        rows = d if rows is None else rows.unionByName(d)
    rows = rows.withColumn("pts_time", F.coalesce(F.col("pts_time").cast("double"), (F.col("start") + F.col("end")) / 2)).where("kf_n IS NOT NULL AND pts_time IS NOT NULL")
    rows = rows.withColumn("chunk_index", F.row_number().over(W.partitionBy("video_id").orderBy("start", "end", "text")) - 1)
    return dense_id(rows, ["video_id", "chunk_index"], "embedding_row")


def object_index(frames: DataFrame, *, video: str, kf: str, json: str, least: float = 0.5) -> DataFrame:
    """(label, hits): inverted index of detections, hits (score, video, kf) by score descending. One array per label and video, so no label gathers the corpus."""
    parsed = frames.select(video, kf, F.from_json(json, "detection_scores array<double>, detection_class_entities array<string>").alias("d"))
    flat = parsed.select(video, kf, F.explode(F.arrays_zip("d.detection_scores", "d.detection_class_entities")).alias("x")).select(video, kf, F.col("x.detection_scores").alias("score"), F.trim("x.detection_class_entities").alias("label"))
    ok = flat.where((F.col("score") >= least) & (F.col("label") != ""))
    return ok.groupBy("label", video).agg(F.sort_array(F.collect_list(F.struct("score", kf)), asc=False).alias("hits"))


def crawl_targets(annotations: DataFrame, media: DataFrame) -> DataFrame:
    """(url, video_ids, splits) of annotated videos that have media; videos without any are in ``missing_media``."""
    j = annotations.join(media, "video_id")
    url = F.regexp_replace(F.lower(F.trim("url")), "^https?://(www\\.)?|/+$", "")
    return j.groupBy(url.alias("url")).agg(F.array_sort(F.collect_set("video_id")).alias("video_ids"), F.array_sort(F.collect_set("split")).alias("splits"))


def missing_media(annotations: DataFrame, media: DataFrame) -> DataFrame:
    """Annotated videos without media."""
    return annotations.join(media, "video_id", "left_anti")


def resume(targets: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """Targets with the status of their latest attempt (key, attempted_at, status), 'pending' without one."""
    last = attempts.groupBy(key).agg(F.max_by("status", "attempted_at").alias("status"))
    return targets.join(last, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def select_scope(canonical: DataFrame, *, packs: list[str] | None = None, videos: list[str] | None = None, first: int | None = None, pilot: bool = False) -> DataFrame:
    """Rows of packs, of videos or of the first videos; a pilot takes the middle keyframe of each."""
    out = canonical
    if packs:
        out = out.where(F.col("pack").isin(packs))
    if videos:
        out = out.where(F.col("video_id").isin(videos))
    if first:
        out = out.join(out.select("video_id").distinct().orderBy("video_id").limit(first), "video_id", "left_semi")
    if pilot:
        w = W.partitionBy("video_id")
        out = out.withColumn("_r", F.row_number().over(w.orderBy("kf_n"))).withColumn("_n", F.count("*").over(w)).where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).drop("_r", "_n")
    return out


def active(df: DataFrame, prefixes: list[str], col: str = "video_id") -> DataFrame:
    """Rows whose id begins with one of the prefixes; ids are upper-cased at ingest so that the filter reaches the scan."""
    clean = sorted({p.strip().upper() for p in prefixes if p.strip()})
    if any(not p.isalnum() for p in clean):
        raise ValueError(f"prefixes must be letters and digits: {clean}")
    test: Column | None = None
    for p in clean:
        test = F.col(col).startswith(p) if test is None else test | F.col(col).startswith(p)
    return df if test is None else df.where(test)


def frame_path(video: Column, kf: Column) -> Column:
    """<video>/<kf, three digits>.jpg"""
    return F.format_string("%s/%03d.jpg", video, kf)


def register_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Temporary views of the catalog tables; returns their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return sorted(tables)


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    """Catalog tables that aren't there."""
    return [n for n in names if not spark.catalog.tableExists(n)]


def archive_members(spark: SparkSession, root: str) -> DataFrame:
    """(pack, archive, member, size) of the ZIP files below a root; several parts make one pack. Only directories of the archives are read per file."""
    import io
    import zipfile

    import pandas as pd

    def members(it):
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame([(path, i.filename, i.file_size) for i in z.infolist()], columns=["archive", "member", "size"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(root).select("path", "content")
    rows = files.mapInPandas(members, "archive string, member string, size long")
    return rows.select(F.regexp_extract("archive", "Videos_([A-Z]\\d{2})", 1).alias("pack"), "archive", "member", "size")


def query_specs(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, task, query, question, events) of JSON files or of text files named query-<id>-<task>.txt."""
    if path.endswith(".json"):
        raw = spark.read.option("multiLine", True).schema("queries array<struct<query_id: string, task: string, query: string, question: string, events: array<string>>>").json(path)
        return raw.select(F.explode("queries").alias("q")).select("q.*")
    text = spark.read.option("pathGlobFilter", "query-*.txt").text(path, wholetext=True).withColumn("f", F.input_file_name())
    parts = F.filter(F.split("value", "\\n\\s*\\n"), lambda x: F.trim(x) != "")
    events = F.regexp_extract_all("value", F.lit("(?m)^\\s*(?:E|Event )?\\d+[:.)]\\s*(.+)$"), F.lit(1))
    return text.select(F.regexp_extract("f", "query-(.+)-[a-z]+\\.txt$", 1).alias("query_id"), F.regexp_extract("f", "-([a-z]+)\\.txt$", 1).alias("task"), F.trim(F.get(parts, F.lit(0))).alias("query"), F.trim(F.get(parts, F.lit(1))).alias("question"), events.alias("events"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its ending: .parquet, .csv, .json or .jsonl."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if path.endswith((".json", ".jsonl")):
        return spark.read.option("multiLine", path.endswith(".json")).json(path)
    return spark.read.parquet(path)


def shard_map(rows: DataFrame, order: list[str]) -> DataFrame:
    """A shard's row map with ``global_id`` from whichever alias it has, else from the total order."""
    have = {c.lower() for c in rows.columns}
    if have & set(ALIASES["global_id"]):
        return unify(rows, ["global_id", "video_id", "kf_n"]).withColumn("global_id", F.col("global_id").cast("long"))
    return dense_id(rows, order, "global_id").select("global_id", "video_id", "kf_n")


def resolve_rows(wanted: DataFrame, shard: DataFrame) -> DataFrame:
    """Row ids (global_id) with their (video_id, kf_n); ``found`` is false for unknown ones."""
    return wanted.join(shard.withColumn("found", F.lit(True)), "global_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def list_shards(shards: DataFrame, *, modality: str | None = None, status: str | None = None) -> DataFrame:
    """Registered embedding shards in order of modality, name and id."""
    out = shards.where(F.col("modality") == modality) if modality else shards
    out = out.where(F.col("status") == status) if status else out
    return out.orderBy("modality", "name", "shard_id")


def list_manifests(shards: DataFrame, most: int = 10_000) -> list[tuple[str, bool]]:
    """Distinct metadata files (at most ``most``) and whether they exist."""
    from pyarrow import fs

    out = []
    for r in shards.where("metadata_path IS NOT NULL").select("metadata_path").distinct().orderBy("metadata_path").limit(most).collect():
        system, path = fs.FileSystem.from_uri(r[0] if "://" in r[0] else f"file://{r[0]}")
        out.append((r[0], system.get_file_info(path).type != fs.FileType.NotFound))
    return out


def discover_source(spark: SparkSession, merged: str, shards: list[str]) -> DataFrame:
    """The merged table where it can be read, else the shards united; the merged one is authoritative."""
    from pyspark.errors import AnalysisException

    try:
        return read_any(spark, merged)
    except AnalysisException:
        rows = None
        for p in shards:
            d = read_any(spark, p)
            rows = d if rows is None else rows.unionByName(d, allowMissingColumns=True)
        if rows is None:
            raise
        return rows


def merge_shards(shards: list[tuple[str, DataFrame]], vec: str) -> DataFrame:
    """Feature shards (pack, rows with video_id, kf_n and vectors) under one dense row id in order of pack, video, keyframe; vectors stay with their keys."""
    rows = None
    for pack, d in shards:
        p = d.select(F.lit(pack).alias("pack"), "video_id", "kf_n", vec)
        rows = p if rows is None else rows.unionByName(p)
    return dense_id(rows, ["pack", "video_id", "kf_n"], "row_id")


def only_videos(df: DataFrame, videos: DataFrame | None) -> DataFrame:
    """Rows of the given videos; no table means no filter."""
    return df if videos is None else df.join(videos.select("video_id").distinct(), "video_id", "left_semi")


def canonicalise(pool: DataFrame, canonical: DataFrame) -> DataFrame:
    """Candidates with the map's frame: unknown keys are dropped, stale frames put right, and ``trace`` says which ('kept', 'remapped')."""
    c = canonical.select("video_id", "kf_n", F.col("frame_idx").alias("_frame")).dropDuplicates(["video_id", "kf_n"])
    j = pool.join(c, ["video_id", "kf_n"])
    return j.withColumn("trace", F.when(F.col("frame_idx").eqNullSafe(F.col("_frame")), "kept").otherwise("remapped")).withColumn("frame_idx", F.col("_frame")).drop("_frame")


def unique_evidence(records: DataFrame, canonical: DataFrame, *, id: str, tolerance: float = 1e-3) -> DataFrame:
    """Records (id, video_id, kf_n, pts_time) that name exactly one row of the map, within the tolerance."""
    c = canonical.select("video_id", "kf_n", "frame_idx", F.col("pts_time").alias("_t"))
    j = records.join(c, ["video_id", "kf_n"]).where(F.abs(F.col("pts_time") - F.col("_t")) <= tolerance)
    return j.withColumn("_n", F.count("*").over(W.partitionBy(id))).where("_n = 1").drop("_n", "_t")


def load_modality(rows: DataFrame, canonical: DataFrame, *, row: str = "embedding_row", silent: DataFrame | None = None) -> DataFrame:
    """A merged modality table after its gates: row ids from 0 without holes, every mapping in the map, no video both silent and seen. Raises, repairs nothing."""
    from keyreel.operators import quality

    ids = quality.contiguous(rows, row).first()
    bad = quality.mapping_report(rows, canonical).where("mapping NOT IN ('ok')").limit(1).count()
    both = quality.both_silent_and_seen(rows, silent).limit(1).count() if silent is not None else 0
    if not ids["contiguous"] or bad or both:
        raise ValueError(f"modality table: contiguous={ids['contiguous']}, bad mappings={bool(bad)}, silent but seen={bool(both)}")
    return rows
