"""Meta-evaluation of a grid of cascaded systems in one job."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metaeval.operators.alignment import align
from metaeval.operators.correlation import oriented, spearman
from metaeval.operators.splits import stack
from metaeval.session import cut, path_exists
from metaeval.sources.inventory import (
    cascade_name, direct_name, list_files, missing_files, relative_to, score_file,
)
from metaeval.sources.scores import scan_score_arrays, scan_scores
from metaeval.sources.text_files import literal_path

DATA = ["dataset", "config", "split"]
HUMAN = "iwslt"
# Names that decide how a model's scores are stored and turned.
LOWER_QE = "google"
LOWER_METRICS = ("google/metricx-23-xl-v2p0", "google/metricx-23-xxl-v2p0")
TEXT_QE = "blaser"
QE_AS_METRIC = ("Unbabel/wmt23-cometkiwi-da-xl", "Unbabel/wmt22-cometkiwi-da")
ARRAY_METRIC = "Unbabel"
HUMAN_DATASET = "ACL"


@dataclass(frozen=True)
class Grid:
    """All combinations of models and systems on one dataset."""

    dataset: str
    config: str
    split: str
    metrics: tuple
    qe_models: tuple
    asr_systems: tuple
    st_systems: tuple


# The published grid.
_METRICS = ("Unbabel/XCOMET-XL", "google/metricx-23-xl-v2p0")
_QE_MODELS = ("Unbabel/XCOMET-XL", "google/metricx-23-xl-v2p0", "blaser_2_0_qe")
_ASR = ("gold", "openai_whisper-large-v3")
PUBLISHED = (
    Grid("covost2", "es_en", "test0-500", _METRICS, _QE_MODELS, _ASR, (
        "openai_whisper-large-v3", "openai_whisper-large-v2", "openai_whisper-medium",
        "openai_whisper-small", "openai_whisper-base")),
    Grid("covost2", "en_de", "test0-500", _METRICS, _QE_MODELS, _ASR, (
        "facebook_hf-seamless-m4t-large", "facebook_hf-seamless-m4t-medium",
        "facebook_s2t-wav2vec2-large-en-de", "facebook_s2t-medium-mustc-multilingual-st",
        "facebook_s2t-small-mustc-en-de-st")),
    Grid("ACL", "en-de", "test", (HUMAN,), (
        "Unbabel/XCOMET-XL", "Unbabel/XCOMET-XXL", "google/metricx-23-xl-v2p0",
        "google/metricx-23-xxl-v2p0", "Unbabel/wmt23-cometkiwi-da-xl",
        "Unbabel/wmt22-cometkiwi-da", "Unbabel/wmt20-comet-qe-da"),
        ("gold", "iwslt23da"), ("iwslt23da",)),
)


def grid_table(spark: SparkSession, grids=PUBLISHED) -> DataFrame:
    """One row per metric, QE model, ASR and ST system of the ``grids``.

    ``system_id`` numbers the rows; ``pool_id`` is shared by the ST systems whose
    scores are pooled, ``qe_id`` by the rows of one QE vector, ``translation_id``
    by those of one translation. Score rows carry numbers instead of names.
    """
    numbers: dict = {}

    def number(kind: str, *names) -> int:
        known = numbers.setdefault(kind, {})
        return known.setdefault(names, len(known))

    rows = []
    for g in grids:
        data = (g.dataset, g.config, g.split)
        for metric, qe, asr, st in product(g.metrics, g.qe_models, g.asr_systems, g.st_systems):
            rows.append((
                len(rows), number("pool", data, metric, qe, asr), number("qe", data, qe, asr, st),
                number("translation", data, st), number("metric", metric), *data, metric, qe, asr,
                st))
    return spark.createDataFrame(
        rows, "system_id int, pool_id int, qe_id int, translation_id int, metric_id int, "
        "dataset string, config string, split string, metric_model string, qe_model string, "
        "asr string, st string")


def qe_is_lower_better(model: Column) -> Column:
    """Whether a QE model gives low scores to good translations."""
    return model.contains(LOWER_QE)


def metric_is_lower_better(model: Column) -> Column:
    """Whether a metric gives low scores to good translations."""
    return model.isin(*LOWER_METRICS)


def qe_path(folders: dict) -> Column:
    """The file of a QE score vector, from the columns of the grid."""
    model = F.col("qe_model")
    in_tsv = model.contains(LOWER_QE) | model.contains(TEXT_QE)
    text = model.contains(TEXT_QE) & ~model.contains(LOWER_QE)
    return score_file(
        F.when(F.col("dataset") == HUMAN_DATASET, folders["human"]).otherwise(folders["qe"]),
        F.when(text, "qe-t2t").otherwise("qe"), model,
        cascade_name(*[F.col(c) for c in ("asr", "st", *DATA)]),
        F.when(in_tsv, ".tsv").otherwise(".json"),
    )


def metric_path(folders: dict) -> Column:
    """The file of a metric or human score vector, from the columns of the grid."""
    model = F.col("metric_model")
    as_qe = model.isin(*QE_AS_METRIC)
    array = model.contains(ARRAY_METRIC)
    human = model.contains(HUMAN) & ~array & ~metric_is_lower_better(model)
    return score_file(
        F.when(as_qe | human, folders["human"]).otherwise(folders["metric"]),
        F.when(as_qe, "qe").when(~human, "metric"), F.when(~human, model),
        direct_name(*[F.col(c) for c in ("st", *DATA)]),
        F.when(array, ".json").otherwise(".tsv"),
    )


# Folder names, to be replaced by the user's own.
FOLDERS = {"qe": "qe", "metric": "metric", "human": "human"}


def check_files(spark: SparkSession, root: str, grid: DataFrame, folders: dict) -> DataFrame:
    """The grid's files; raises, naming some, if any does not exist."""
    expected = grid.select(F.explode(F.array(qe_path(folders), metric_path(folders)))
                           .alias("path")).distinct()
    existing = None
    for folder in sorted(set(folders.values())):
        if path_exists(spark, f"{root}/{folder}"):
            listed = list_files(spark, f"{root}/{folder}").select(
                relative_to(F.col("path"), root).alias("path"))
            existing = stack(existing, listed)
    absent = expected if existing is None else missing_files(expected, existing)
    first = absent.orderBy("path").limit(5).collect()
    if first:
        raise FileNotFoundError(f"missing score files, among them {[r[0] for r in first]}")
    return expected


def read_vectors(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """All score vectors as ``path``, ``pos``, ``value``: one scan per file layout.

    ``files`` has one row per file of the grid; its paths are handed to the reader.
    """
    by_kind: dict = {}
    for (path,) in files.select("path").toLocalIterator():
        name = path.rsplit("/", 1)[-1]
        kind = "array" if name.endswith(".json") else "raw" if name.startswith("st.") else "score"
        by_kind.setdefault(kind, []).append(literal_path(f"{root}/{path}"))
    vectors = None
    for kind, paths in sorted(by_kind.items()):
        scan = scan_score_arrays(spark, paths) if kind == "array" else scan_scores(
            spark, paths, kind).withColumn("system_score", F.lit(None).cast("double"))
        vectors = stack(vectors, scan)
    return vectors.select(relative_to(F.col("system"), root).alias("path"), "pos", "value", "system_score")


def check_vectors(grid: DataFrame, vectors: DataFrame, folders: dict) -> DataFrame:
    """Rows and mean of every file of the grid; raises if a vector is missing or too short.

    Every file must have given scores, and a list of metric scores must be as long as
    the QE vectors it is set beside. A metric table may be longer or shorter.
    """
    found = vectors.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max("system_score"), F.avg("value")).alias("mean"))
    # one row per file that the configuration names
    sizes = {r["path"]: (r["n"], r["mean"]) for r in found.collect()}
    pairs = grid.select(qe_path(folders).alias("qe"), metric_path(folders).alias("metric")).distinct().collect()
    lost = sorted({p for r in pairs for p in (r["qe"], r["metric"]) if p not in sizes})
    if lost:
        raise ValueError(f"no scores came from these files, among others: {lost[:5]}")
    uneven = [(r["qe"], sizes[r["qe"]][0], r["metric"], sizes[r["metric"]][0]) for r in pairs
              if r["metric"].endswith(".json") and sizes[r["qe"]][0] != sizes[r["metric"]][0]]
    if uneven:
        raise ValueError(f"score lists of unequal length, among them: {uneven[:5]}")
    return grid.sparkSession.createDataFrame([(p, m) for p, (_, m) in sizes.items()], "path string, mean double")


def check_metrics(grids) -> None:
    """Raise for a metric model whose files and orientation are not known."""
    unknown = [m for g in grids for m in g.metrics
               if not (m in QE_AS_METRIC or m in LOWER_METRICS or ARRAY_METRIC in m or HUMAN in m)]
    if unknown:
        raise ValueError(f"metric models not supported: {sorted(set(unknown))}")


def cascade_pairs(grid: DataFrame, qe: DataFrame, metric: DataFrame) -> DataFrame:
    """Oriented QE and metric scores, aligned by position, for every grid row.

    ``qe`` has the data columns, ``qe_model``, ``asr``, ``st``, ``pos``, ``qe``;
    ``metric`` the data columns, ``metric_model``, ``st``, ``pos``, ``metric``.
    The grid is configuration and broadcast. All metrics of a segment are brought
    together first, so a QE row crosses the network once however many metrics it
    is compared with. Both sides meet on the translation's number and the
    position, which no value repeats.
    """
    qe_ids = grid.select(*DATA, "qe_model", "asr", "st", "qe_id", "translation_id").distinct()
    metric_ids = grid.select(
        *DATA, "metric_model", "st", "translation_id", "metric_id").distinct()
    turned = oriented(F.col("qe"), qe_is_lower_better(F.col("qe_model"))).alias("qe")
    other = oriented(F.col("metric"), metric_is_lower_better(F.col("metric_model")))
    first = qe.join(F.broadcast(qe_ids), [*DATA, "qe_model", "asr", "st"]).select(
        "translation_id", "pos", "qe_id", turned)
    # one entry per metric model
    second = (
        metric.join(F.broadcast(metric_ids), [*DATA, "metric_model", "st"])
        .groupBy("translation_id", "pos")
        .agg(F.map_from_entries(F.collect_list(F.struct("metric_id", other))).alias("_metrics"))
    )
    wanted = grid.select("qe_id", "metric_id", "system_id", "pool_id")
    return align(first, second, ["translation_id"]).join(F.broadcast(wanted), "qe_id").select(
        "system_id", "pool_id", "qe", F.element_at("_metrics", F.col("metric_id")).alias("metric"))


def correlate_grid(grid: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    """Correlations of every grid system, and pooled over the ST systems."""
    found = spearman(pairs, "qe", "metric", ["system_id", "pool_id"],
                     levels={"system": ["system_id"], "pooled": ["pool_id"]}, **options)
    names = ["level", "_id", *DATA, "metric_model", "qe_model", "asr", "st"]
    # literal rows, as many as the configuration names
    labels = stack(
        grid.withColumns({"level": F.lit("system"), "_id": F.col("system_id")}),
        grid.withColumns({"level": F.lit("pooled"), "_id": F.col("pool_id"),
                          "st": F.lit(None).cast("string")}),
    ).select(*names).distinct()
    return (
        found.withColumn("_id", F.coalesce("system_id", "pool_id"))
        .join(F.broadcast(labels), ["level", "_id"])
        .select(*[c for c in names if c != "_id"], "n_rows", "n_pairs", "spearman")
    )


def run_cascade(spark: SparkSession, root: str, grids=PUBLISHED, folders=None, **options
                ) -> DataFrame:
    """Correlations of a whole grid of score files below ``root``.

    The rows of single systems also have the mean scores of their two files: the
    stored one where the file states it.
    """
    folders = {**FOLDERS, **(folders or {})}
    check_metrics(grids)
    # literal rows, as many as the configuration names
    grid = grid_table(spark, grids)
    files = check_files(spark, root, grid, folders)
    # the checks, the QE side and the metric side read the written rows: every file is parsed once
    vectors = cut(read_vectors(spark, root, files))
    means = check_vectors(grid, vectors, folders)
    vectors = vectors.drop("system_score")
    qe_keys = [*DATA, "qe_model", "asr", "st"]
    metric_keys = [*DATA, "metric_model", "st"]
    qe_names = grid.select(*qe_keys, qe_path(folders).alias("path")).distinct()
    metric_names = grid.select(*metric_keys, metric_path(folders).alias("path")).distinct()
    qe = vectors.join(F.broadcast(qe_names), "path").drop("path").withColumnRenamed("value", "qe")
    metric = vectors.join(F.broadcast(metric_names), "path").drop("path").withColumnRenamed(
        "value", "metric")
    found = correlate_grid(grid, cascade_pairs(grid, qe, metric), **options)
    # literal rows, as many as the configuration names
    names = grid.select(*metric_keys, "qe_model", "asr", qe_path(folders).alias("_qe"), metric_path(folders).alias("_metric"))
    for side in ("qe", "metric"):
        known = means.select(F.col("path").alias(f"_{side}"), F.col("mean").alias(f"{side}_mean"))
        names = names.join(F.broadcast(known), f"_{side}").drop(f"_{side}")
    return found.join(F.broadcast(names), [*metric_keys, "qe_model", "asr"], "left")
