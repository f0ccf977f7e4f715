"""Queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import lexicon, schemas
from quarry.config import DEFAULT
from quarry.functions import arrays, text
from quarry.operators import align, audit, bootstrap, candidates, classification, diff, fusion, nlg, regions, sampling, seams, tables, tensors, texthead
from quarry.plans.durable import cut, shared_dir
from quarry.plans.number import numbered
from quarry.plans.workers import importable
from quarry.sources import labels, shards, sinks
from quarry.sources import predictions as src
from quarry.streaming import resume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


COMPARED = ("volume_name", "Question", "GT_combined_report", "Pred_combined_report", "source", "split")


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.differences(
        table(spark, sf_dir, "predictions"), table(spark, sf_dir, "predictions_mirror"), "sample_id", COMPARED,
        id_fields=["volume_name"], only_left="only_in_predictions", only_right="only_in_mirror",
    )


def _p4_sql(select: str) -> str:
    squeeze = "trim(regexp_replace(nfc_normalize(coalesce({}, '')), '[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
    value = {f: squeeze.format(f) for f in COMPARED}
    value["volume_name"] = f"regexp_replace(regexp_replace({value['volume_name']}, '\\.nii\\.gz$', '', 'i'), '_([a-z])(_[0-9]+)?$', '\\1', 'i')"
    cells = " UNION ALL ".join(
        f"SELECT DISTINCT sample_id, '{f}' AS field, {v} AS v, '{side}' AS side FROM {t}"
        for side, t in (("a", "predictions"), ("b", "predictions_mirror"))
        for f, v in value.items()
    )
    return f"""WITH cells AS ({cells}),
lone AS (SELECT sample_id, CASE min(side) WHEN 'a' THEN 'only_in_predictions' ELSE 'only_in_mirror' END AS diff FROM cells GROUP BY sample_id HAVING count(DISTINCT side) = 1),
cellwise AS (SELECT DISTINCT sample_id, field AS diff FROM (SELECT sample_id, field, v FROM cells GROUP BY ALL HAVING count(DISTINCT side) = 1) WHERE sample_id NOT IN (SELECT sample_id FROM lone)),
found AS (SELECT * FROM lone UNION ALL SELECT * FROM cellwise)
{select}"""


@query("p4_found", _p4_sql("SELECT sample_id, diff FROM found"))
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4(spark, sf_dir)


@query("p4_counts", _p4_sql("SELECT diff, count(*) AS n FROM found GROUP BY diff"))
def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.difference_counts(_p4(spark, sf_dir))

# ---------------------------------------------------------------- shared SQL pieces

#: white space as Python's and Java's Unicode classes see it
_WS = "[\\s\\x{000b}\\x{001c}-\\x{001f}\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _canon(c: str) -> str:
    return f"regexp_replace(regexp_replace(trim({c}), '\\.nii\\.gz$', '', 'i'), '_([a-z])(_[0-9]+)?$', '\\1', 'i')"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"


def _tokens(c: str) -> str:
    return f"list_filter(string_split({_squeeze(f'lower({c})')}, ' '), lambda x: x <> '')"


def _sentences(c: str, headers: bool) -> str:
    t = _squeeze(c)
    if headers:
        t = f"regexp_replace({t}, ': +([A-Z])', '. \\1', 'g')"
    return f"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?]) +([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


_PRF = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall"
_F1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END"
_COUNTS = "count(*) FILTER (gt = 1 AND pred = 1) AS tp, count(*) FILTER (gt = 0 AND pred = 1) AS fp, count(*) FILTER (gt = 1 AND pred = 0) AS fn, count(*) FILTER (gt = 0 AND pred = 0) AS tn"

# ---------------------------------------------------------------- sources, nulls, keys


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions")


@query("load_predictions", f"""SELECT id, sample_id, gt, pred FROM (
    SELECT {_canon('volume_name')} AS id, sample_id, GT_combined_report AS gt, Pred_combined_report AS pred,
           row_number() OVER (PARTITION BY {_canon('volume_name')} ORDER BY sample_id) AS r
    FROM predictions WHERE GT_combined_report IS NOT NULL AND Pred_combined_report IS NOT NULL) WHERE r = 1""")  # fmt: skip
def load_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, projection, null filter, canonical id, first row of each id."""
    return src.normalised(predictions(spark, sf_dir), order="sample_id")


@query("labellable_texts", """SELECT source, volume_name, sample_id FROM (
    SELECT *, row_number() OVER (PARTITION BY source, volume_name ORDER BY sample_id) AS r FROM predictions) WHERE r = 1 AND """ + f"{_squeeze('Pred_combined_report')} <> ''")  # fmt: skip
def labellable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each source and volume with a text that is not blank."""
    first = align.keep_first(predictions(spark, sf_dir), ["source", "volume_name"], "sample_id")
    return first.filter(text.squeeze(F.col("Pred_combined_report")) != "").select("source", "volume_name", "sample_id")


@query("csv_round_trip", "SELECT sample_id, volume_name, GT_combined_report, Pred_combined_report FROM predictions")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All predictions written as CSV and read back: line breaks, quotes, nulls and empty texts survive."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    cols = ["sample_id", "volume_name", "GT_combined_report", "Pred_combined_report"]
    sinks.write_csv(predictions(spark, sf_dir).select(*cols), path)
    return src.read_csv(spark, path, schemas.PREDICTIONS_A).select(*cols)


@query("summary_json", "SELECT source, count(*) AS n, count(GT_combined_report) AS gt, count(Pred_combined_report) AS pred FROM predictions GROUP BY source")
def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary written as JSON and read back."""
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    s = predictions(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("GT_combined_report").alias("gt"), F.count("Pred_combined_report").alias("pred"))
    sinks.write_json(s, path)
    return spark.read.schema("source string, n long, gt long, pred long").json(path)


@query("label_columns", "SELECT source, side, volumes, " + ", ".join(f'labels[{i + 1}] AS "L_{n}"' for i, n in enumerate(lexicon.LABELS)) + " FROM label_cache")
def label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label vectors as one column for each condition."""
    return classification.wide_labels(table(spark, sf_dir, "label_cache"), lexicon.LABELS, {"L": "labels"})


@query("label_cache_keys", "SELECT source, side, replace('predictions/' || source || '/' || side, '/', '__') AS cache_key, count(*) AS n FROM label_cache GROUP BY ALL")
def label_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the label cache by source and side, with their keys."""
    key = text.cache_key(F.concat(F.lit("predictions/"), "source", F.lit("/"), "side"))
    return table(spark, sf_dir, "label_cache").groupBy("source", "side", key.alias("cache_key")).agg(F.count(F.lit(1)).alias("n"))


@query("shard_accessions", "SELECT sample_idx, split_part(list_extract(string_split(image_path, '/'), -2), '.', 1) AS accession, split_part(list_extract(string_split(image_path, '/'), -1), '.', 1) AS name FROM shard_index")
def shard_accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accession and file stem from the image path."""
    p = F.col("image_path")
    return table(spark, sf_dir, "shard_index").select("sample_idx", text.accession(p).alias("accession"), text.stem_of(p).alias("name"))


@query("shard_assignment", """SELECT shard, first_member, n, (row_number() OVER (ORDER BY shard) - 1) % 4 AS worker FROM (
    SELECT shard, arg_min(member, regexp_extract(member, '[0-9]+')::BIGINT) AS first_member, count(*) AS n FROM shard_index GROUP BY shard)""")  # fmt: skip
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with their first member in numeric order, dealt to four workers in turn."""
    number = F.regexp_extract("member", "([0-9]+)", 1).cast("long")
    shards = table(spark, sf_dir, "shard_index").groupBy("shard").agg(F.min_by("member", number).alias("first_member"), F.count(F.lit(1)).alias("n"))
    return sampling.assigned(shards, "shard", 4)


@query("shard_epoch_order", """SELECT shard, row_number() OVER (ORDER BY md5('10-' || shard), shard) - 1 AS place FROM (SELECT DISTINCT shard FROM shard_index)""")
def shard_epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the shards in epoch 3 of seed 7."""
    return sampling.epoch_order(table(spark, sf_dir, "shard_index").select("shard").distinct(), "shard", 7, 3)


_VOL = "regexp_replace(regexp_replace(list_extract(string_split(image_path, '/'), -1), '\\.nii\\.gz$', '', 'i'), '_([a-z])(_[0-9]+)?$', '\\1', 'i')"


def shard_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "shard_index").select("sample_idx", text.canonical_id(F.element_at(F.split("image_path", "/"), -1)).alias("id"))


@query("pending_volumes", f"SELECT sample_idx, {_VOL} AS id FROM shard_index WHERE {_VOL} NOT IN (SELECT {_canon('volume_name')} FROM predictions WHERE volume_name IS NOT NULL)")
def pending_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of the shards without a prediction yet (anti-join)."""
    done = predictions(spark, sf_dir).select(text.canonical_id(F.col("volume_name")).alias("id")).dropna()
    return align.pending(shard_volumes(spark, sf_dir), done, "id")


@query("reported_volumes", f"SELECT sample_idx, {_VOL} AS id FROM shard_index WHERE {_VOL} IN (SELECT {_canon('Volumename')} FROM region_reports)")
def reported_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of the shards with a region report (semi-join)."""
    reports = table(spark, sf_dir, "region_reports").select(text.canonical_id(F.col("Volumename")).alias("id"))
    return align.reported(shard_volumes(spark, sf_dir), reports, "id")


@query("first_samples", "SELECT sample_idx, member FROM shard_index ORDER BY sample_idx LIMIT 200")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 samples, as a capped evaluation takes them."""
    return table(spark, sf_dir, "shard_index").orderBy("sample_idx").limit(200).select("sample_idx", "member")


@query("key_rewrite", f"""WITH want AS (SELECT DISTINCT {_canon('volume_name')} AS key FROM predictions WHERE volume_name IS NOT NULL),
have AS (SELECT DISTINCT i, s, key FROM (SELECT 0 AS i, 'as_is' AS s, image_path AS key FROM shard_index
    UNION ALL SELECT 1, 'file_name', list_extract(string_split(image_path, '/'), -1) FROM shard_index
    UNION ALL SELECT 2, 'canonical', {_VOL} FROM shard_index))
SELECT s AS strategy, count(want.key) AS matched FROM have LEFT JOIN want USING (key) GROUP BY i, s ORDER BY matched DESC, i LIMIT 1""")
def key_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three ways to rewrite keys, the one that meets most keys of the other side."""
    have = table(spark, sf_dir, "shard_index").select(F.col("image_path").alias("key"))
    want = predictions(spark, sf_dir).select(text.canonical_id(F.col("volume_name")).alias("key")).dropna()
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return align.best_key_rewrite(have, want, {"as_is": lambda c: c, "file_name": name, "canonical": lambda c: text.canonical_id(name(c))})


# ---------------------------------------------------------------- fusion and scores

FUSIONS = {
    "pair": ["gen_alder", "gen_birch"],
    "other_pair": ["gen_cedar", "gen_elm"],
    "triple": ["gen_alder", "gen_birch", "gen_cedar"],
    "four": ["gen_alder", "gen_birch", "gen_cedar", "gen_dogwood"],
    "six": ["gen_alder", "gen_birch", "gen_cedar", "gen_dogwood", "gen_elm", "gen_fir"],
}
_CAT = "cat(fusion, source, members) AS (VALUES " + ", ".join(f"('{f}', '{s}', {len(ss)})" for f, ss in FUSIONS.items() for s in ss) + ")"
_FUSED = f"""{_CAT},
long AS (SELECT source, volumes AS key, unnest(range(0, len(labels))) AS idx, unnest(labels) AS label FROM label_cache WHERE side = 'Pred'),
sums AS (SELECT fusion, members, key, idx, sum(label) AS n FROM long JOIN cat USING (source) GROUP BY fusion, members, key, idx HAVING count(*) = members),
fused AS (SELECT fusion, 'or' AS mode, key, idx, (n > 0)::INT AS pred FROM sums
    UNION ALL SELECT fusion, 'and', key, idx, (n = members)::INT FROM sums WHERE members = 2
    UNION ALL SELECT fusion, 'majority', key, idx, (n > members / 2.0)::INT FROM sums WHERE members >= 3),
truth AS (SELECT volumes AS key, unnest(range(0, len(labels))) AS idx, unnest(labels) AS gt FROM label_cache WHERE side = 'GT'),
pairs AS (SELECT fusion, mode, key, idx, gt, pred FROM fused JOIN truth USING (key, idx)),
labels AS (SELECT fusion, mode, idx, {_COUNTS} FROM pairs GROUP BY fusion, mode, idx),
scores AS (SELECT *, {_F1} AS f1 FROM (SELECT *, {_PRF} FROM labels)),
micro AS (SELECT fusion, mode, precision AS micro_precision, recall AS micro_recall, {_F1} AS micro_f1, macro_f1 FROM (
    SELECT fusion, mode, macro_f1, {_PRF} FROM (SELECT fusion, mode, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(f1) AS macro_f1 FROM scores GROUP BY fusion, mode)))"""


def label_vectors(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return table(spark, sf_dir, "label_cache").filter(F.col("side") == side).select("source", F.col("volumes").alias("key"), "labels")


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(label_vectors(spark, sf_dir, "Pred"), fusion.catalogue(spark, FUSIONS))


def fused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.pairs_with_truth(fused(spark, sf_dir), label_vectors(spark, sf_dir, "GT"))


@query("fusion_labels", f"WITH {_FUSED} SELECT fusion, mode, key, list(pred ORDER BY idx) AS labels FROM fused GROUP BY fusion, mode, key")
def fusion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR, AND and majority of every fusion of the catalogue, over volumes that all sources have."""
    return fused(spark, sf_dir)


@query("fusion_common", f"WITH {_FUSED} SELECT fusion, count(DISTINCT key) AS n FROM pairs GROUP BY fusion")
def fusion_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes common to all sources of a fusion and the reference."""
    return fused_pairs(spark, sf_dir).groupBy("fusion").agg(F.countDistinct("key").alias("n"))


@query("fusion_scores", f"WITH {_FUSED} SELECT * FROM micro")
def fusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro precision, recall, F1 and macro F1 of every fusion and mode."""
    return classification.micro_macro(fused_pairs(spark, sf_dir), ["fusion", "mode"])


@query("fusion_label_scores", f"WITH {_FUSED} SELECT fusion, mode, idx, tp, fp, fn, tn, precision, recall, f1, tp + fn AS support FROM scores")
def fusion_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and scores of every condition."""
    return classification.scored(classification.confusion(fused_pairs(spark, sf_dir), ["fusion", "mode", "idx"]))


@query("fusion_weighted", f"""WITH {_FUSED} SELECT fusion, mode, sum(tp + fn) AS support, """ + ", ".join(
    f"CASE WHEN sum(tp + fn) = 0 THEN 0.0 ELSE sum({c} * (tp + fn)) / sum(tp + fn) END AS {c}" for c in ("precision", "recall", "f1")) + " FROM scores GROUP BY fusion, mode")
def fusion_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support-weighted averages."""
    return classification.weighted(fusion_label_scores(spark, sf_dir), ["fusion", "mode"])


@query("fusion_summary", f"""WITH {_FUSED}, plan AS (SELECT DISTINCT fusion, unnest(CASE WHEN members = 2 THEN ['or', 'and'] ELSE ['or', 'majority'] END) AS mode FROM cat)
SELECT fusion, mode, coalesce(printf('%.4f', micro_f1), 'FAILED') AS cell FROM plan LEFT JOIN micro USING (fusion, mode)""")
def fusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned fusions with their F1, or FAILED where they have no common volumes."""
    return fusion.summary(fusion_scores(spark, sf_dir), fusion.catalogue(spark, FUSIONS))


def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = label_vectors(spark, sf_dir, "Pred").select(F.col("source").alias("fusion"), F.lit("single").alias("mode"), "key", "labels")
    return fusion.pairs_with_truth(pred, label_vectors(spark, sf_dir, "GT")).withColumnRenamed("fusion", "source").drop("mode")


_SINGLE = """p AS (SELECT source, volumes AS key, unnest(range(0, len(labels))) AS idx, unnest(labels) AS pred FROM label_cache WHERE side = 'Pred'),
g AS (SELECT volumes AS key, unnest(range(0, len(labels))) AS idx, unnest(labels) AS gt FROM label_cache WHERE side = 'GT'),
pairs AS (SELECT * FROM p JOIN g USING (key, idx))"""


@query("source_report", f"""WITH {_SINGLE},
l AS (SELECT *, {_F1} AS f1 FROM (SELECT *, {_PRF} FROM (SELECT source, idx, {_COUNTS} FROM pairs GROUP BY source, idx))),
m AS (SELECT *, {_F1} AS f1 FROM (SELECT *, {_PRF} FROM (SELECT source, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM l GROUP BY source))),
s AS (SELECT *, {_F1} AS f1 FROM (SELECT *, {_PRF} FROM (SELECT source, key, {_COUNTS} FROM pairs GROUP BY source, key)))
SELECT source, 'micro' AS average, precision, recall, f1 FROM m
UNION ALL SELECT source, 'macro', avg(precision), avg(recall), avg(f1) FROM l GROUP BY source
UNION ALL SELECT source, 'weighted', """ + ", ".join(f"CASE WHEN sum(tp + fn) = 0 THEN 0.0 ELSE sum({c} * (tp + fn)) / sum(tp + fn) END" for c in ("precision", "recall", "f1")) + """ FROM l GROUP BY source
UNION ALL SELECT source, 'samples', avg(precision), avg(recall), avg(f1) FROM s GROUP BY source""")  # fmt: skip
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro, macro, weighted and per-sample averages of each source."""
    return classification.report(source_pairs(spark, sf_dir), ["source"])


@query("grand_total", f"""WITH {_SINGLE}
SELECT *, {_F1} AS f1, tp + fn AS support FROM (SELECT *, {_PRF} FROM (SELECT CASE WHEN grouping(idx) = 1 THEN -1 ELSE idx END AS idx, {_COUNTS} FROM pairs GROUP BY GROUPING SETS ((idx), ())))""")  # fmt: skip
def grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each condition and of all together, by grouping sets."""
    return classification.with_total(source_pairs(spark, sf_dir))


@query("label_consistency", f"""WITH {_SINGLE}, c AS (SELECT count(*) AS n, {_COUNTS} FROM pairs), x AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS p, tp / greatest(tp + fn, 1)::DOUBLE AS r FROM c)
SELECT n, tp, fp, fn, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(2 * p * r / greatest(p + r, 1e-9), 4) AS f1 FROM x""")
def label_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of all predicted with all reference labels."""
    return classification.consistency(source_pairs(spark, sf_dir))


@query("exact_match", """SELECT p.source, avg((p.labels = g.labels)::INT) AS accuracy FROM label_cache p JOIN label_cache g ON p.volumes = g.volumes AND p.side = 'Pred' AND g.side = 'GT' GROUP BY p.source""")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of label sequences that agree in every place."""
    p, g = label_vectors(spark, sf_dir, "Pred"), label_vectors(spark, sf_dir, "GT").select("key", F.col("labels").alias("gt"))
    return p.join(g, "key").groupBy("source").agg(F.avg(arrays.exact_match(F.col("labels"), F.col("gt")).cast("int")).alias("accuracy"))


# ---------------------------------------------------------------- tables

_METRIC_LONG = """l AS (SELECT source, Condition AS condition, metric, coalesce(v, 0.0) AS v FROM (SELECT source, Condition, unnest(['Precision', 'Recall', 'F1']) AS metric, unnest([Precision, Recall, F1]) AS v FROM condition_metrics)),
w AS (SELECT *, v = max(v) OVER (PARTITION BY condition, metric) AND v > 0 AS best FROM l),
c AS (SELECT *, CASE WHEN best THEN '\\textbf{' || cell || '}' ELSE cell END AS shown FROM (SELECT *, regexp_replace(printf('%.3f', v), '^0', '') AS cell FROM w))"""


@query("metric_winners", f"WITH {_METRIC_LONG} SELECT source, condition, metric, v, best, shown AS cell FROM c")
def metric_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each source and condition; all that reach the maximum are bold."""
    return tables.winners(tables.long_metrics(table(spark, sf_dir, "condition_metrics")))


_DIM = "d(bucket, ord, condition, label) AS (VALUES " + ", ".join("('{}', {}, '{}', '{}')".format(b, bi * 100 + ci, c, lab) for bi, (b, cs) in enumerate(lexicon.PREVALENCE) for ci, (c, lab) in enumerate(cs)) + ")"


@query("latex_rows", f"""WITH {_METRIC_LONG}, {_DIM}
SELECT bucket, ord, label || ' & ' || string_agg(shown, ' & ' ORDER BY source, CASE metric WHEN 'Precision' THEN 0 WHEN 'Recall' THEN 1 ELSE 2 END) || ' \\\\' AS line FROM c JOIN d USING (condition) GROUP BY bucket, ord, label""")
def latex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body of the comparison table."""
    return tables.latex_rows(metric_winners(spark, sf_dir))


# ---------------------------------------------------------------- sentences and audit


@query("sentences_with_headers", f"SELECT sample_id, len({_sentences('Pred_combined_report', True)}) AS n, array_to_string({_sentences('Pred_combined_report', True)}, chr(1)) AS s FROM predictions WHERE Pred_combined_report IS NOT NULL")
def sentences_with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every predicted report, headers ending at their colon."""
    s = text.sentences(F.col("Pred_combined_report"))
    return predictions(spark, sf_dir).filter("Pred_combined_report is not null").select("sample_id", F.size(s).cast("long").alias("n"), F.array_join(s, "\x01").alias("s"))


_COUNTED = f"""s AS (SELECT row_id, unnest(range(0, len(x))) AS p, lower(unnest(x)) AS sentence FROM (SELECT row_id, {_sentences('Sentence', False)} AS x FROM region_reports WHERE Sentence IS NOT NULL)),
n AS (SELECT sentence, count(*) AS n, min((row_id, p)) AS first FROM s GROUP BY sentence)"""


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sentence_counts(table(spark, sf_dir, "region_reports"), "Sentence", "row_id")


@query("sentence_frequency", f"WITH {_COUNTED} SELECT sentence, n FROM n")
def sentence_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct sentence of the region reports with its frequency."""
    return sentence_counts(spark, sf_dir).select("sentence", "n")


@query("top_sentences", f"WITH {_COUNTED} SELECT sentence, n FROM n ORDER BY n DESC, first LIMIT 15")
def top_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 most frequent sentences, equals in order of first occurrence."""
    return audit.most_frequent(sentence_counts(spark, sf_dir), 15)


#: stock phrases of the test texts, audited beside the default ones
PHRASES = lexicon.AUDITED | {"heart": "Heart appears unremarkable.", "pleura": "There is no pleural thickening.", "general": "Findings as before."}
_PHRASES = "ph(region, phrase) AS (VALUES " + ", ".join(f"('{r}', '{p}')" for r, p in PHRASES.items()) + ")"


@query("phrase_audit", f"""WITH {_COUNTED}, {_PHRASES},
t AS (SELECT n.*, {_tokens('sentence')} AS w FROM n),
j AS (SELECT region, phrase, n, (sentence = lower(phrase))::INT AS same, CASE WHEN len(w) = 0 THEN 0.0 ELSE {_jaccard(_tokens('phrase'), 'w')} END AS j FROM t, ph),
g AS (SELECT region, phrase, sum(n * same)::BIGINT AS exact, sum(CASE WHEN j >= 0.6 THEN n ELSE 0 END)::BIGINT AS fuzzy FROM j GROUP BY region, phrase)
SELECT *, CASE WHEN exact + fuzzy >= 100 THEN 'VALIDATED' ELSE 'LOW-FREQUENCY' END AS status FROM g""")
def phrase_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often stock phrases occur, exactly and nearly."""
    return audit.phrase_audit(sentence_counts(spark, sf_dir), PHRASES)


@query("average_words", f"SELECT source, avg(len({_tokens('Pred_combined_report')})) AS pred, avg(len({_tokens('GT_combined_report')})) AS gt FROM predictions WHERE Pred_combined_report IS NOT NULL AND GT_combined_report IS NOT NULL GROUP BY source")
def average_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average number of words of predicted and reference reports."""
    full = predictions(spark, sf_dir).dropna(subset=["Pred_combined_report", "GT_combined_report"])
    n = lambda c: F.avg(F.size(text.tokens(F.col(c))))
    return full.groupBy("source").agg(n("Pred_combined_report").alias("pred"), n("GT_combined_report").alias("gt"))


# ---------------------------------------------------------------- candidates

_CAND = f"c AS (SELECT {_canon('volume_name')} AS volume, sample_id AS k, coalesce(Pred_combined_report, '') AS t FROM predictions WHERE volume_name IS NOT NULL)"


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).filter("volume_name is not null")
    return p.select(text.canonical_id(F.col("volume_name")).alias("volume"), F.col("sample_id").alias("k"), F.col("Pred_combined_report").alias("text"))


@query("candidate_union", f"WITH {_CAND} SELECT volume, string_agg(t, ' ' ORDER BY k) AS text FROM c GROUP BY volume")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of a volume in order."""
    return candidates.united(candidate_rows(spark, sf_dir), "volume", "k", "text")


def _consistent_sql(n: int) -> str:
    return f"""WITH {_CAND}, w AS (SELECT *, list_distinct({_tokens('t')}) AS w, count(*) OVER (PARTITION BY volume) AS m FROM c),
s AS (SELECT a.volume, a.k, a.t, a.m, coalesce(sum(CASE WHEN a.k = b.k THEN 0.0 ELSE {_jaccard('a.w', 'b.w')} END ORDER BY b.k), 0) / greatest(a.m - 1, 1) AS s FROM w a JOIN w b USING (volume) GROUP BY a.volume, a.k, a.t, a.m),
r AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY round(s, 12) DESC, k) AS r FROM s)
SELECT volume, CASE WHEN max(m) <= {n} THEN string_agg(t, ' ' ORDER BY k) ELSE string_agg(t, ' ' ORDER BY r) FILTER (r <= {n}) END AS text FROM r GROUP BY volume"""


@query("self_consistent", _consistent_sql(1))
def self_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate most like the others."""
    return candidates.self_consistent(candidate_rows(spark, sf_dir), "volume", "k", "text", 1)


@query("self_consistent_two", _consistent_sql(2))
def self_consistent_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two candidates most like the others, best first."""
    return candidates.self_consistent(candidate_rows(spark, sf_dir), "volume", "k", "text", 2)


@query("best_scored", f"WITH {_CAND}, w AS (SELECT *, len(list_distinct({_tokens('t')})) AS s FROM c) SELECT volume, t AS text FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY s DESC, k) AS r FROM w) WHERE r = 1")
def best_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate with the highest score (distinct words), the first of equals."""
    rows = candidate_rows(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    return candidates.best_scored(rows.withColumn("score", F.size(F.array_distinct(text.tokens(F.col("text"))))), "volume", "k", "score", "text")


@query("temperatures", "SELECT name, k, lo + (hi - lo) * i / greatest(k - 1, 1) AS t, i FROM (SELECT *, unnest(range(0, k)) AS i FROM (VALUES ('default', 0.7, 1.3), ('low', 0.3, 0.7), ('medium', 0.5, 1.0), ('high', 1.0, 1.5)) b(name, lo, hi), (VALUES (1), (3), (10)) ks(k))")
def temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature schedules of all bands for one, three and ten candidates."""
    rows = [(n, k, lo, hi) for n, (lo, hi) in DEFAULT.bands.items() for k in (1, 3, 10)]
    out = None
    for n, k, lo, hi in rows:
        part = spark.range(1).select(F.lit(n).alias("name"), F.lit(k).alias("k"), F.posexplode(arrays.temperatures(F.lit(k), lo, hi)).alias("i", "t"))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- embeddings

_CENTROID = """e AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
q AS (SELECT label, d, avg(x) AS x FROM e GROUP BY label, d),
s AS (SELECT vec_id, e.label, sum(e.x * q.x) / (sqrt(sum(e.x * e.x)) * sqrt(sum(q.x * q.x))) AS score FROM e JOIN q ON e.label = q.label AND e.d = q.d GROUP BY vec_id, e.label)"""


def centroid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    flat = e.select("label", F.posexplode("embedding").alias("d", "x"))
    mean = flat.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    q = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda v: v["x"]).alias("embedding"))
    return candidates.alignment_scores(e, q, "label", "embedding")


@query("cosine_scores", f"WITH {_CENTROID} SELECT vec_id, label, round(score, 5) AS score FROM s")
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the mean of its label."""
    return centroid_scores(spark, sf_dir).select("vec_id", "label", F.round("score", 5).alias("score"))


@query("rerank", f"WITH {_CENTROID} SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) AS r FROM s) WHERE r = 1")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector that fits its label best."""
    return candidates.best_scored(centroid_scores(spark, sf_dir).withColumn("score", F.round("score", 9)), "label", "vec_id", "score", "vec_id").select("label", "vec_id")


@query("contrastive_loss", """WITH e AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
q AS (SELECT label, d, avg(x) AS x FROM e GROUP BY label, d),
s AS (SELECT a.label AS i, b.label AS j, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) / 0.07 AS sim FROM q a JOIN q b USING (d) GROUP BY a.label, b.label),
r AS (SELECT i, ln(sum(exp(sim))) AS l FROM s GROUP BY i), c AS (SELECT j, ln(sum(exp(sim))) AS l FROM s GROUP BY j)
SELECT round(((SELECT sum(l) FROM r) + (SELECT sum(l) FROM c) - 2 * (SELECT sum(sim) FROM s WHERE i = j)) / (2 * (SELECT count(*) FROM r)), 6) AS loss""")
def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric cross entropy of the label means against themselves."""
    flat = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    mean = flat.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    q = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda v: v["x"]).alias("v"))
    # the loss compares all rows of a batch, here a batch of up to 32 labels
    batch = F.floor(F.col("label") / 32).alias("batch")
    sims = q.select(batch, F.col("label").alias("i"), F.col("v").alias("a")).join(q.select(batch, F.col("label").alias("j"), F.col("v").alias("b")), "batch")
    sims = sims.withColumn("sim", arrays.cosine(F.col("a"), F.col("b")) / 0.07)
    return candidates.contrastive_loss(sims, "i", "j", "sim").select(F.round("loss", 6).alias("loss"))


# ---------------------------------------------------------------- regions


def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.latest(table(spark, sf_dir, "region_reports"))


_LATEST = f"latest AS (SELECT volume, region, text FROM (SELECT {_canon('Volumename')} AS volume, coalesce(lower(trim(Anatomy)), 'whole') AS region, Sentence AS text, row_number() OVER (PARTITION BY {_canon('Volumename')}, coalesce(lower(trim(Anatomy)), 'whole') ORDER BY row_id DESC) AS r FROM region_reports) WHERE r = 1)"
_REGION_DIM = "rd(k, region) AS (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(lexicon.REGIONS)) + ")"


@query("region_latest", f"WITH {_LATEST} SELECT * FROM latest")
def region_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of each volume and region."""
    return region_rows(spark, sf_dir)


@query("region_maps", f"WITH {_LATEST} SELECT volume, count(*) AS n, string_agg(region, ',' ORDER BY region) AS names FROM latest GROUP BY volume")
def region_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region maps of the volumes, shown by their keys."""
    m = regions.maps(region_rows(spark, sf_dir))
    return m.select("volume", F.size("regions").cast("long").alias("n"), F.array_join(F.sort_array(F.map_keys("regions")), ",").alias("names"))


@query("region_every", f"WITH {_LATEST}, {_REGION_DIM} SELECT v.volume, rd.region, coalesce(l.text, '') AS text FROM (SELECT DISTINCT volume FROM latest) v CROSS JOIN rd LEFT JOIN latest l ON l.volume = v.volume AND l.region = rd.region")
def region_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of every volume, empty where none is reported."""
    return regions.with_every_region(region_rows(spark, sf_dir))


@query("region_reported", f"WITH {_LATEST}, {_REGION_DIM} SELECT volume, region, text FROM latest JOIN rd USING (region) WHERE text IS NOT NULL")
def region_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the regions that are reported, as for training."""
    return regions.with_every_region(region_rows(spark, sf_dir), keep_missing=False)


@query("combined_report", f"""WITH {_LATEST}, {_REGION_DIM}, r AS (SELECT volume, region, text, k, row_number() OVER (PARTITION BY volume ORDER BY k) - 1 AS i FROM latest JOIN rd USING (region) WHERE trim(coalesce(text, '')) <> '')
SELECT volume, string_agg('The region ' || i || ' is ' || region || ': ' || text || ' ', '' ORDER BY k) AS report FROM r GROUP BY volume""")
def combined_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of each volume, numbered and joined to one report."""
    return regions.combined(region_rows(spark, sf_dir))


@query("prompt", f"""SELECT sample_id, length(p) AS n, md5(p) AS h FROM (SELECT sample_id, '<image>{''.join(f'<image{i}>' for i in range(32))}</image>' ||
    'The region 0 is <region>{''.join(f'<region{i}>' for i in range(33))}</region>. ' || coalesce(Question, '') AS p FROM predictions)""")
def prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with image and region placeholders, shown by length and digest."""
    p = text.placeholder_prompt(F.col("Question"), F.array(F.lit("whole")))
    return predictions(spark, sf_dir).select("sample_id", F.length(p).cast("long").alias("n"), F.md5(p.cast("binary")).alias("h"))


# ---------------------------------------------------------------- arrays


@query("intensity_window", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (least(greatest(x::DOUBLE * 2000, -1000), 200) + 400) / 600)), 4) AS s,
    len(list_filter(embedding, lambda x: x::DOUBLE * 2000 >= 200)) AS clipped FROM embeddings""")
def intensity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped and normalised intensities, summed."""
    x = F.transform("embedding", lambda v: v.cast("double") * 2000)
    total = F.aggregate(arrays.windowed(x), F.lit(0.0), lambda a, v: a + v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 4).alias("s"), F.size(F.filter(x, lambda v: v >= 200)).cast("long").alias("clipped"))


@query("masked_sum", "SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN i % 4 = 1 THEN embedding[i]::DOUBLE ELSE -1024.0 END)), 4) AS s FROM embeddings")
def masked_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside a mask set to the background, summed."""
    mask = F.transform("embedding", lambda v, i: (i % 4 == 0).cast("int"))
    m = arrays.masked(F.transform("embedding", lambda v: v.cast("double")), mask)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(m, F.lit(0.0), lambda a, v: a + v), 4).alias("s"))


@query("usable_masks", "SELECT source, side, count(*) AS n FROM label_cache WHERE list_sum(labels) <> 0 GROUP BY source, side")
def usable_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with at least one element set, by source."""
    return table(spark, sf_dir, "label_cache").filter(arrays.has_any(F.transform("labels", lambda x: x.cast("double")))).groupBy("source", "side").agg(F.count(F.lit(1)).alias("n"))


@query("training_labels", "SELECT source, side, volumes, list_transform(range(1, len(labels) + 1), lambda i: CASE WHEN labels[i] = 0 OR labels[i] >= 5 OR i <= 3 THEN -100 ELSE labels[i] END) AS ids FROM label_cache")
def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token labels with padding, foreign ids and the prompt ignored."""
    return table(spark, sf_dir, "label_cache").select("source", "side", "volumes", arrays.training_labels(F.col("labels"), F.lit(3), 5).alias("ids"))


@query("padded_rows", f"SELECT sample_id, list_concat(w, list_transform(range(0, greatest(m - len(w), 0)), lambda i: 0)) AS ids FROM (SELECT *, max(len(w)) OVER (PARTITION BY sample_id // 16) AS m FROM (SELECT sample_id, list_transform({_tokens('Question')}, lambda x: length(x)) AS w FROM predictions WHERE Question IS NOT NULL))")
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch padded with zeros to its longest row."""
    ids = F.transform(text.tokens(F.col("Question")), lambda x: F.length(x))
    rows = predictions(spark, sf_dir).filter("Question is not null").select("sample_id", F.floor(F.col("sample_id") / 16).alias("batch"), ids.alias("w"))
    longest = F.max(F.size("w")).over(Window.partitionBy("batch"))
    return rows.withColumn("m", longest).select("sample_id", arrays.padded(F.col("w"), F.col("m")).alias("ids"))


@query("mean_pooled", """WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, (i % 8)::INT AS d, round(avg(x), 6) AS x FROM e WHERE i // 8 < 1 + vec_id % 8 GROUP BY vec_id, i % 8""")
def mean_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the unmasked tokens of each sample: eight tokens of eight numbers, the last ones padded."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: (t <= F.col("vec_id") % 8).cast("int"))
    pooled = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.mean_pool(tokens, mask)).alias("d", "x"))
    return pooled.select("vec_id", "d", F.round("x", 6).alias("x"))


@query("thresholded", "SELECT vec_id, list_transform(embedding, lambda x: (1 / (1 + exp(-(x::DOUBLE))) > 0.5)::INT) AS y FROM embeddings")
def thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of logits."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: arrays.positive(x)).alias("y"))


@query("elapsed", "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS t FROM (SELECT event_id, floor(value * 100)::BIGINT AS s FROM events)")
def elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as hours, minutes and seconds."""
    return table(spark, sf_dir, "events").select("event_id", text.clock(F.floor(F.col("value") * 100)).alias("t"))


# ---------------------------------------------------------------- text head

PROPOSERS = ["gen_alder", "gen_birch", "gen_cedar"]


def proposer_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts of three sources and their OR labels, for volumes that all three and the cache have."""
    who = F.create_map(*(F.lit(x) for i, s in enumerate(PROPOSERS) for x in (s, i)))
    rows = predictions(spark, sf_dir).filter(F.col("source").isin(*PROPOSERS) & F.col("volume_name").isNotNull())
    rows = rows.select(text.canonical_id(F.col("volume_name")).alias("volume"), "source", "sample_id", F.coalesce("Pred_combined_report", F.lit("")).alias("text"))
    first = align.keep_first(rows, ["volume", "source"], "sample_id")
    common = align.common_rows(first, "volume", "source", len(PROPOSERS)).withColumn("p_idx", who[F.col("source")])
    fused_all = fusion.fuse(label_vectors(spark, sf_dir, "Pred"), fusion.catalogue(spark, {"t": PROPOSERS})).filter("mode = 'or'")
    labels = fused_all.select(text.canonical_id(F.col("key")).alias("volume"), "labels").dropDuplicates(["volume"])
    return common.join(labels.select("volume"), "volume", "left_semi").select("volume", "p_idx", "text"), labels.join(common.select("volume").distinct(), "volume", "left_semi")


def all_source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).filter("volume_name is not null and Pred_combined_report is not null")
    rows = rows.select(text.canonical_id(F.col("volume_name")).alias("volume"), F.col("source").alias("p_idx"), "sample_id", F.col("Pred_combined_report").alias("text"))
    return align.keep_first(rows, ["volume", "p_idx"], "sample_id")


_ALL_TEXTS = f"""f AS (SELECT * FROM (SELECT {_canon('volume_name')} AS volume, source AS p_idx, Pred_combined_report AS t, row_number() OVER (PARTITION BY {_canon('volume_name')}, source ORDER BY sample_id) AS r FROM predictions WHERE volume_name IS NOT NULL AND Pred_combined_report IS NOT NULL) WHERE r = 1),
s AS (SELECT volume, p_idx, unnest(range(0, len(x))) AS s_idx, unnest(x) AS sent FROM (SELECT *, {_sentences('t', True)} AS x FROM f))"""


@query("sentence_agreement", f"""WITH {_ALL_TEXTS}, w AS (SELECT *, {_tokens('sent')} AS w FROM s),
g AS (SELECT volume, p_idx, s_idx, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
x AS (SELECT volume, p_idx, s_idx, len(g) AS m, unnest(g) AS gram FROM g),
c AS (SELECT a.volume, a.p_idx, a.s_idx, b.p_idx AS p2, b.s_idx AS s2, count(*) / (any_value(a.m) + any_value(b.m) - count(*))::DOUBLE AS j FROM x a JOIN x b ON a.volume = b.volume AND a.gram = b.gram AND a.p_idx <> b.p_idx GROUP BY a.volume, a.p_idx, a.s_idx, b.p_idx, b.s_idx)
SELECT volume, p_idx, s_idx, count(DISTINCT p2)::INT AS agreement FROM c WHERE j >= 0.4 GROUP BY volume, p_idx, s_idx""")
def sentence_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other sources have a similar sentence for the same volume, for every sentence with any."""
    return texthead.agreement(texthead.candidates(all_source_texts(spark, sf_dir), {}))


_NEG = "|".join(lexicon.NEGATIONS).replace("'", "''")
_EDGE = "[^\\p{L}\\p{M}\\p{N}_]"
_MEASURE = f"(^|{_EDGE})[0-9]+(\\.[0-9]+)?\\s*(mm|cm)($|{_EDGE})|(^|{_EDGE})[0-9]+\\s*[x×]\\s*[0-9]+($|{_EDGE})"
_HITS = "list_filter([" + ", ".join("CASE WHEN regexp_matches(l, '{}') THEN '{}' END".format("|".join(ps).replace("'", "''"), c) for c, ps in lexicon.SYNONYMS.items()) + "], lambda x: x IS NOT NULL)"


@query("sentence_mentions", f"""WITH {_ALL_TEXTS}, n AS (SELECT volume, p_idx, s_idx, lower(sent) AS l FROM s)
SELECT volume, p_idx, s_idx, regexp_matches(l, '{_NEG}') AS negated, array_to_string({_HITS}, ';') AS hits, regexp_matches(l, '{_MEASURE}') AS measured, len(regexp_extract_all(l, '{lexicon.LOCATION}'))::INT AS places FROM n""")
def sentence_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions named in every sentence, with negation, measurements and places."""
    each = all_source_texts(spark, sf_dir).select("volume", "p_idx", F.posexplode(text.sentences(F.col("text"))).alias("s_idx", "sent"))
    low = F.lower("sent")
    return each.select(
        "volume", "p_idx", "s_idx", text.negated(low).alias("negated"), F.array_join(text.mentions(low), ";").alias("hits"),
        text.measured(low).alias("measured"), text.places(low).alias("places"),
    )


def _text_head_sql() -> str:
    """The greedy choice goes on row by row in a recursion, every volume by itself."""
    who = ", ".join(f"('{p}', {i})" for i, p in enumerate(PROPOSERS))
    names = ", ".join(f"({i}, '{n}', '{lexicon.REGION[n]}', {lexicon.REGIONS.index(lexicon.REGION[n])})" for i, n in enumerate(lexicon.LABELS))
    stock = ", ".join(f"({lexicon.REGIONS.index(r)}, '{r}', '{' '.join(lexicon.STOCK.get(r, []))}')" for r in lexicon.REGIONS)
    cfg = DEFAULT
    words = f"list_filter(string_split({_squeeze('sent')}, ' '), lambda x: x <> '')"
    cut_line = f"CASE WHEN len({words}) > {cfg.longest_sentence} THEN array_to_string(({words})[1:{cfg.longest_sentence}], ' ') || '.' ELSE sent END"
    prefix = f"left(trim(regexp_replace(lower(sent), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}]+', ' ', 'g')), {cfg.prefix})"
    return f"""WITH RECURSIVE who(source, p_idx) AS (VALUES {who}), nm(c, name, region, k) AS (VALUES {names}), st(k, region, stock) AS (VALUES {stock}),
f AS (SELECT volume, p_idx, t FROM (SELECT {_canon('volume_name')} AS volume, p_idx, coalesce(Pred_combined_report, '') AS t, row_number() OVER (PARTITION BY {_canon('volume_name')}, p_idx ORDER BY sample_id) AS r FROM predictions JOIN who USING (source) WHERE volume_name IS NOT NULL) WHERE r = 1),
ll AS (SELECT volumes, unnest(range(0, len(labels))) AS c, unnest(labels) AS l FROM label_cache WHERE side = 'Pred' AND source IN ({", ".join(f"'{p}'" for p in PROPOSERS)})),
lab AS (SELECT {_canon('volumes')} AS volume, c, (sum(l) > 0)::INT AS l FROM ll GROUP BY volumes, c HAVING count(*) = {len(PROPOSERS)}),
v AS (SELECT volume FROM f WHERE volume IN (SELECT volume FROM lab) GROUP BY volume HAVING count(*) = {len(PROPOSERS)}),
s AS (SELECT volume, p_idx, unnest(range(0, len(x))) AS s_idx, unnest(x) AS sent FROM (SELECT *, {_sentences('t', True)} AS x FROM f WHERE volume IN (SELECT volume FROM v))),
w AS (SELECT *, lower(sent) AS l, {_tokens('sent')} AS w FROM s),
h AS (SELECT *, regexp_matches(l, '{_NEG}') AS neg, {_HITS} AS hits FROM w),
g AS (SELECT volume, p_idx, s_idx, list_distinct(list_transform(range(1, len(w) - {cfg.agree_ngram - 2}), lambda i: array_to_string(w[i:i + {cfg.agree_ngram - 1}], ' '))) AS g FROM w WHERE len(w) >= {cfg.agree_ngram}),
x AS (SELECT volume, p_idx, s_idx, len(g) AS m, unnest(g) AS gram FROM g),
j AS (SELECT a.volume, a.p_idx, a.s_idx, b.p_idx AS p2, count(*) / (any_value(a.m) + any_value(b.m) - count(*))::DOUBLE AS j FROM x a JOIN x b ON a.volume = b.volume AND a.gram = b.gram AND a.p_idx <> b.p_idx GROUP BY a.volume, a.p_idx, a.s_idx, b.p_idx, b.s_idx),
ag AS (SELECT volume, p_idx, s_idx, count(DISTINCT p2) AS n FROM j WHERE j >= {cfg.agree_at} GROUP BY ALL),
hit AS (SELECT volume, p_idx, s_idx, neg, unnest(hits) AS name FROM h),
fit AS (SELECT volume, p_idx, s_idx, c, l, neg FROM hit JOIN nm USING (name) JOIN lab USING (volume, c)),
poll AS (SELECT volume, p_idx, s_idx, count(*) FILTER (l = 0 AND NOT neg) AS n FROM fit GROUP BY ALL),
sc AS (SELECT h.volume, h.p_idx, h.s_idx, {prefix} AS prefix, regexp_replace({cut_line}, '[. ]+$', '') || '.' AS line,
    CASE WHEN regexp_matches(h.l, '{_MEASURE}') THEN {cfg.weight_measure}::DOUBLE ELSE 0.0::DOUBLE END + {cfg.weight_place}::DOUBLE * least(len(regexp_extract_all(h.l, '{lexicon.LOCATION}')), {cfg.most_places})
    + {cfg.weight_word}::DOUBLE * least(len(w), {cfg.most_words}) + {cfg.weight_agree}::DOUBLE * coalesce(ag.n, 0) - {cfg.weight_pollution}::DOUBLE * coalesce(poll.n, 0) AS score
    FROM h LEFT JOIN ag USING (volume, p_idx, s_idx) LEFT JOIN poll USING (volume, p_idx, s_idx)),
it AS (SELECT volume, c, prefix, line, row_number() OVER (PARTITION BY volume ORDER BY c, -score, p_idx, s_idx) AS rn FROM fit JOIN sc USING (volume, p_idx, s_idx) WHERE (l = 1) = (NOT neg)),
rec AS (SELECT volume, rn, c, 1 AS n, [prefix] AS seen, true AS take FROM it WHERE rn = 1
    UNION ALL SELECT volume, rn, c, before + took::INT, CASE WHEN took THEN list_append(seen, prefix) ELSE seen END, took FROM (
        SELECT it.volume, it.rn, it.c, it.prefix, rec.seen, CASE WHEN rec.c = it.c THEN rec.n ELSE 0 END AS before,
            (CASE WHEN rec.c = it.c THEN rec.n ELSE 0 END) < {cfg.top_k} AND NOT list_contains(rec.seen, it.prefix) AS took FROM rec JOIN it ON it.volume = rec.volume AND it.rn = rec.rn + 1)),
pk AS (SELECT volume, c, string_agg(line, ' ' ORDER BY rn) AS t FROM it JOIN rec USING (volume, rn, c) WHERE take GROUP BY volume, c),
cond AS (SELECT volume, k, c, coalesce(t, name || CASE WHEN l = 1 THEN ' was detected.' ELSE ' was not detected.' END) AS t FROM lab JOIN v USING (volume) JOIN nm USING (c) LEFT JOIN pk USING (volume, c)),
body AS (SELECT v.volume, st.k, st.region, trim(coalesce((SELECT string_agg(t, ' ' ORDER BY c) FROM cond WHERE cond.volume = v.volume AND cond.k = st.k), '') || ' ' || st.stock) AS b FROM v, st),
num AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY k) - 1 AS i FROM body WHERE b <> '')
SELECT volume, string_agg('The region ' || i || ' is ' || region || ': ' || b, ' ' ORDER BY k) AS report FROM num GROUP BY volume"""


@query("text_head", _text_head_sql())
def text_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractive report of each volume that three sources share."""
    return texthead.build(*proposer_texts(spark, sf_dir))


@query("dedup_prefix", f"WITH {_ALL_TEXTS} SELECT prefix, count(*) AS n FROM (SELECT left(trim(regexp_replace(lower(sent), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}]+', ' ', 'g')), 40) AS prefix FROM s) GROUP BY prefix")
def dedup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the prefix under which they count as the same."""
    each = all_source_texts(spark, sf_dir).select(F.explode(text.sentences(F.col("text"))).alias("s"))
    return each.groupBy(text.dedup_prefix(F.col("s")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query("finished_sentences", f"WITH {_ALL_TEXTS}, w AS (SELECT volume, p_idx, s_idx, sent, list_filter(string_split({_squeeze('sent')}, ' '), lambda x: x <> '') AS w FROM s) SELECT volume, p_idx, s_idx, regexp_replace(CASE WHEN len(w) > 12 THEN array_to_string(w[1:12], ' ') || '.' ELSE sent END, '[. ]+$', '') || '.' AS line FROM w")
def finished_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences cut to twelve words with one full stop at the end."""
    each = all_source_texts(spark, sf_dir).select("volume", "p_idx", F.posexplode(text.sentences(F.col("text"))).alias("s_idx", "sent"))
    return each.select("volume", "p_idx", "s_idx", text.finished(text.shortened(F.col("sent"), 12)).alias("line"))


@query("lexicon_labels", f"""WITH s AS (SELECT sample_id, unnest({_sentences("coalesce(Pred_combined_report, '')", True)}) AS sent FROM predictions),
h AS (SELECT sample_id, flatten(list(CASE WHEN regexp_matches(l, '{_NEG}') THEN [] ELSE {_HITS} END)) AS h FROM (SELECT sample_id, lower(sent) AS l FROM s) GROUP BY sample_id)
SELECT p.sample_id, list_transform([{", ".join(f"'{n}'" for n in lexicon.LABELS)}], lambda n: coalesce(list_contains(h, n), false)::INT) AS labels FROM predictions p LEFT JOIN h USING (sample_id)""")
def lexicon_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every predicted report by the default labeller."""
    return labels.lexicon_labels(predictions(spark, sf_dir), "sample_id", "Pred_combined_report")


# ---------------------------------------------------------------- NLG scores


def nlg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("sample_id", "source", text.canonical_id(F.col("volume_name")).alias("id"), "GT_combined_report", "Pred_combined_report")
    return nlg.row_stats(p, "GT_combined_report", "Pred_combined_report").drop("GT_combined_report", "Pred_combined_report")


_BLEU = f"""t AS (SELECT sample_id, source, {_tokens('GT_combined_report')} AS r, {_tokens('Pred_combined_report')} AS h FROM predictions WHERE {_squeeze("coalesce(GT_combined_report, '')")} <> '' AND {_squeeze("coalesce(Pred_combined_report, '')")} <> ''),
n AS (SELECT sample_id, o, g, count(*) FILTER (side = 'h') AS ch, count(*) FILTER (side = 'r') AS cr FROM (
    SELECT sample_id, 'h' AS side, o, unnest(list_transform(range(1, len(h) - o + 2), lambda i: array_to_string(h[i:i + o - 1], ' '))) AS g FROM t, (VALUES (1), (2), (3), (4)) os(o)
    UNION ALL SELECT sample_id, 'r', o, unnest(list_transform(range(1, len(r) - o + 2), lambda i: array_to_string(r[i:i + o - 1], ' '))) FROM t, (VALUES (1), (2), (3), (4)) os(o)) GROUP BY sample_id, o, g),
c AS (SELECT sample_id, o, sum(least(ch, cr)) AS clip FROM n GROUP BY sample_id, o),
s AS (SELECT source, o, sum(coalesce(clip, 0))::DOUBLE AS clip, sum(greatest(1, len(h) - o + 1))::DOUBLE AS tot, sum(len(h))::DOUBLE AS hl, sum(len(r))::DOUBLE AS rl, count(*) AS rows
    FROM t CROSS JOIN (VALUES (1), (2), (3), (4)) os(o) LEFT JOIN c USING (sample_id, o) GROUP BY source, o),
p AS (SELECT source, o, ln(CASE WHEN clip > 0 THEN clip ELSE 0.1 END / tot) AS l, CASE WHEN hl > rl THEN 1.0 WHEN hl = 0 THEN 0.0 ELSE exp(1 - rl / hl) END AS bp, rows FROM s)"""


@query("bleu", f"WITH {_BLEU} SELECT a.source, any_value(a.rows) AS n, b.o, round(any_value(a.bp) * exp(avg(a.l)) * 100, 4) AS bleu FROM p a JOIN (VALUES (1), (2), (3), (4)) b(o) ON a.o <= b.o GROUP BY a.source, b.o")
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus BLEU-1 to BLEU-4 of each source."""
    s = nlg_stats(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in nlg.STATS))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.round(nlg.bleu(i) * 100, 4).alias("bleu")) for i in range(1, 5))))
    return s.select("source", "n", each.alias("x")).select("source", "n", "x.*")


@query("nlg_scores")
def nlg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU, METEOR and ROUGE-L of each source."""
    return nlg.corpus_scores(nlg_stats(spark, sf_dir), ["source"])


# ---------------------------------------------------------------- bootstrap

_STATS = ("hl", "rl", *(f"{x}{i}" for x in "ct" for i in range(1, 5)))


def _bleu_of(p: str) -> str:
    logs = " + ".join(f"ln(CASE WHEN {p}_c{i} > 0 THEN {p}_c{i} ELSE 0.1 END / {p}_t{i}) / 4" for i in range(1, 5))
    return f"CASE WHEN {p}_c1 = 0 THEN 0.0 ELSE CASE WHEN {p}_hl > {p}_rl THEN 1.0 WHEN {p}_hl = 0 THEN 0.0 ELSE exp(1 - {p}_rl / {p}_hl) END * exp({logs}) END"


RESAMPLES = DEFAULT.resamples
_JACC_ROWS = f"""f AS (SELECT * FROM (SELECT source, {_canon('volume_name')} AS id, sample_id, GT_combined_report AS g, Pred_combined_report AS p, row_number() OVER (PARTITION BY source, {_canon('volume_name')} ORDER BY sample_id) AS r FROM predictions WHERE volume_name IS NOT NULL AND GT_combined_report IS NOT NULL AND Pred_combined_report IS NOT NULL) WHERE r = 1),
sc AS (SELECT source, id, sample_id, {_jaccard(_tokens('g'), _tokens('p'))} * 100 AS s FROM f),
pr AS (SELECT b.id, b.s AS base, o.s AS ours, row_number() OVER (ORDER BY b.sample_id) - 1 AS row FROM sc b JOIN sc o ON b.id = o.id AND b.source = 'gen_birch' AND o.source = 'gen_alder')"""


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row, base, ours``: word-set similarity with the reference, of two sources on the same volumes."""
    rows = predictions(spark, sf_dir).dropna(subset=["volume_name", "GT_combined_report", "Pred_combined_report"])
    rows = rows.select("source", text.canonical_id(F.col("volume_name")).alias("id"), "sample_id", F.col("GT_combined_report").alias("g"), F.col("Pred_combined_report").alias("p"))
    first = align.keep_first(rows, ["source", "id"], "sample_id")
    s = first.select("source", "id", F.col("sample_id").alias("ord"), (text.set_jaccard(text.tokens(F.col("g")), text.tokens(F.col("p"))) * 100).alias("s"))
    by = lambda name: s.filter(F.col("source") == name).drop("source")
    j = align.paired(by("gen_birch"), by("gen_alder"), "id", "ord")
    return j.select("row", "id", F.col("s_base").alias("base"), F.col("s_ours").alias("ours"))


@query("paired_scores", f"WITH {_JACC_ROWS} SELECT row, id, base, ours FROM pr")
def paired_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two sources on the same volumes, numbered in base order."""
    return score_pairs(spark, sf_dir)


@query("bootstrap_interval", f"""WITH {_JACC_ROWS}, n AS (SELECT count(*) AS n FROM pr),
d AS (SELECT b, ('0x' || substr(md5(concat_ws('-', 0, b, slot)), 1, 8))::BIGINT % n AS row FROM n, (SELECT unnest(range(0, {RESAMPLES})) AS b), (SELECT unnest(range(0, n)) AS slot FROM n)),
x AS (SELECT b, avg(ours - base) AS delta FROM d JOIN pr USING (row) GROUP BY b)
SELECT round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.025), 6) AS ci_lower, round(quantile_cont(delta, 0.975), 6) AS ci_upper, avg((delta > 0)::INT) AS p_greater, count(*) AS n_ok FROM x""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of two sources with its 95 % interval."""
    rows = cut(score_pairs(spark, sf_dir), "scores")
    w = bootstrap.weights(spark, RESAMPLES, rows.count())
    i = bootstrap.interval(bootstrap.mean_deltas(rows, w, "base", "ours"))
    return i.select(*(F.round(c, 6).alias(c) for c in ("mean_delta", "ci_lower", "ci_upper")), "p_greater", "n_ok")


@query("bootstrap_markdown", f"""WITH {_JACC_ROWS}, n AS (SELECT count(*) AS n FROM pr),
d AS (SELECT b, ('0x' || substr(md5(concat_ws('-', 0, b, slot)), 1, 8))::BIGINT % n AS row FROM n, (SELECT unnest(range(0, {RESAMPLES})) AS b), (SELECT unnest(range(0, n)) AS slot FROM n)),
x AS (SELECT b, avg(ours - base) AS delta FROM d JOIN pr USING (row) GROUP BY b)
SELECT '| words | ' || printf('%+.2f', avg(delta)) || ' | ' || printf('[%+.2f, %+.2f]', quantile_cont(delta, 0.025), quantile_cont(delta, 0.975)) || ' | ' || printf('%.3f', avg((delta > 0)::INT)) || ' |' AS line FROM x""")
def bootstrap_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval as a row of a Markdown table."""
    i = bootstrap_interval(spark, sf_dir)
    cells = tables.interval_cells(*(F.col(c) for c in ("mean_delta", "ci_lower", "ci_upper", "p_greater")))
    return i.select(tables.markdown_row([F.lit("words"), *cells]).alias("line"))


@query("bootstrap_bleu", f"""WITH {_BLEU}, fb AS (SELECT * FROM (SELECT t.source, {_canon('volume_name')} AS id, sample_id, r, h, row_number() OVER (PARTITION BY t.source, {_canon('volume_name')} ORDER BY sample_id) AS k FROM t JOIN predictions USING (sample_id) WHERE volume_name IS NOT NULL) WHERE k = 1),
st AS (SELECT source, id, sample_id, len(h) AS hl, len(r) AS rl, {", ".join(f"coalesce((SELECT clip FROM c WHERE c.sample_id = fb.sample_id AND o = {i}), 0) AS c{i}, greatest(1, len(h) - {i - 1}) AS t{i}" for i in range(1, 5))} FROM fb WHERE source IN ('gen_birch', 'gen_alder')),
pr AS (SELECT row_number() OVER (ORDER BY b.sample_id) - 1 AS row, {", ".join(f"b.{x} AS b_{x}, a.{x} AS a_{x}" for x in _STATS)} FROM st b JOIN st a ON a.id = b.id AND b.source = 'gen_birch' AND a.source = 'gen_alder'),
nn AS (SELECT count(*) AS n FROM pr),
d AS (SELECT b, ('0x' || substr(md5(concat_ws('-', 0, b, slot)), 1, 8))::BIGINT % n AS row FROM nn, (SELECT unnest(range(0, {RESAMPLES})) AS b), (SELECT unnest(range(0, n)) AS slot FROM nn)),
g AS (SELECT b, {", ".join(f"sum({p}_{x})::DOUBLE AS {p}_{x}" for p in "ab" for x in _STATS)} FROM d JOIN pr USING (row) GROUP BY b),
e AS (SELECT b, (({_bleu_of("a")}) - ({_bleu_of("b")})) * 100 AS delta FROM g)
SELECT round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.025), 6) AS ci_lower, round(quantile_cont(delta, 0.975), 6) AS ci_upper, avg((delta > 0)::INT) AS p_greater, count(*) AS n_ok FROM e""")
def bootstrap_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of corpus BLEU-4 of two sources with its 95 % interval."""
    s = nlg_stats(spark, sf_dir).filter("id is not null")
    first = align.keep_first(s, ["source", "id"], "sample_id")
    by = lambda name, p: first.filter(F.col("source") == name).select("id", "sample_id", *(F.col(c).alias(p + c) for c in nlg.STATS))
    j = by("gen_birch", "base_").join(by("gen_alder", "ours_").drop("sample_id"), "id")
    rows = cut(numbered(j, "sample_id"), "stats")
    w = bootstrap.weights(spark, RESAMPLES, rows.count())
    i = bootstrap.interval(bootstrap.bleu_deltas(rows, w))
    return i.select(*(F.round(c, 6).alias(c) for c in ("mean_delta", "ci_lower", "ci_upper")), "p_greater", "n_ok")


_U = "('0x' || substr(md5(concat_ws('-', 0, b, id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_POISSON = "CASE " + " ".join(f"WHEN u < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(bootstrap.POISSON)) + f" ELSE {len(bootstrap.POISSON)} END"


@query("bootstrap_poisson", f"""WITH {_JACC_ROWS}, u AS (SELECT b, ours - base AS d, {_U} AS u FROM pr, (SELECT unnest(range(0, {RESAMPLES})) AS b)),
x AS (SELECT b, sum(d * w) / nullif(sum(w), 0) AS delta FROM (SELECT b, d, {_POISSON} AS w FROM u) GROUP BY b HAVING sum(w) > 0)
SELECT round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.025), 6) AS ci_lower, round(quantile_cont(delta, 0.975), 6) AS ci_upper, avg((delta > 0)::INT) AS p_greater, count(*) AS n_ok FROM x""")
def bootstrap_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval by Poisson weights, without a shuffle of the draws."""
    i = bootstrap.interval(bootstrap.poisson_deltas(score_pairs(spark, sf_dir), RESAMPLES, "id", "base", "ours"))
    return i.select(*(F.round(c, 6).alias(c) for c in ("mean_delta", "ci_lower", "ci_upper")), "p_greater", "n_ok")


# ---------------------------------------------------------------- streaming and sampling


@query("resumed_ingest", "SELECT DISTINCT ON (event_id) event_id, user_id, event_type FROM events")
def resumed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in by a resumable stream, run twice: the second run finds nothing new."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for _ in range(2):
        resume.ingest(importable(spark), f"{sf_dir}/events.parquet", schema, f"{at}/table", f"{at}/checkpoint", "event_id")
    return spark.read.parquet(f"{at}/table").select("event_id", "user_id", "event_type")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type by hour."""
    got = resume.windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour")
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("buffered_shuffle", "SELECT sample_idx, member FROM shard_index")
def buffered_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples, in the order of a shuffle buffer."""
    return sampling.buffered_shuffle(table(spark, sf_dir, "shard_index").select("sample_idx", "member"), 100, 7)


@query("random_patches", "SELECT shard, sample_idx FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY md5('5-' || sample_idx), sample_idx) AS r FROM shard_index) WHERE r <= 20")
def random_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty random samples of each shard."""
    return sampling.top_random(table(spark, sf_dir, "shard_index"), "shard", 20, 5, "sample_idx").select("shard", "sample_idx")


# ---------------------------------------------------------------- batches and seams


def region_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch, volume, t``: word and character counts of the regions of each volume, in batches by shard member."""
    m = regions.maps(region_rows(spark, sf_dir).filter("region <> 'whole' and text is not null"))
    t = F.transform_values("regions", lambda k, v: F.array(F.size(text.tokens(v)).cast("double"), F.length(v).cast("double")))
    batch = F.floor(F.nullif(F.regexp_extract("volume", "_([0-9]+)", 1), F.lit("")).cast("long") / 16)
    return m.select(batch.alias("batch"), "volume", t.alias("t"))


@query("collated_batches", f"""WITH {_LATEST}, {_REGION_DIM},
x AS (SELECT nullif(regexp_extract(volume, '_([0-9]+)', 1), '')::BIGINT // 16 AS batch, volume, region, [len({_tokens('text')})::DOUBLE, length(text)::DOUBLE] AS v FROM latest WHERE region <> 'whole' AND text IS NOT NULL),
p AS (SELECT DISTINCT batch, region FROM x JOIN rd USING (region)), v AS (SELECT DISTINCT batch, volume FROM x)
SELECT v.batch, v.volume, p.region, coalesce(x.v, [0.0, 0.0]::DOUBLE[]) AS "values" FROM v JOIN p USING (batch) LEFT JOIN x ON x.volume = v.volume AND x.region = p.region""")
def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of region tensors with zeros for absent regions; regions that a batch lacks are dropped."""
    return tensors.collated(region_tensors(spark, sf_dir), "batch", "volume", "t", 2)


@query("present_regions", f"""WITH {_LATEST}, m AS (SELECT volume, list(region ORDER BY region) AS names FROM latest WHERE region IN ('heart', 'lung', 'pleura') GROUP BY volume)
SELECT volume, list_transform(range(1, len(names) + 1), lambda i: (i - 1) || ':' || names[i]) AS area FROM m""")
def present_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that have a mask, numbered in order."""
    mask = F.create_map(*(x for r in ("heart", "lung", "pleura") for x in (F.lit(r), F.lit(1))))
    m = regions.maps(region_rows(spark, sf_dir)).select("volume", regions.present_only(F.col("regions"), mask).alias("r"))
    area = regions.numbered(F.sort_array(F.map_keys("r")))
    named = F.transform(F.map_entries(area), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"]))
    return m.filter(F.size("r") > 0).select("volume", named.alias("area"))


@query("running_labels", "SELECT source, side, volumes, list_transform(range(1, len(labels) + 1), lambda i: list_sum(labels[1:i])::INT) AS seen FROM label_cache")
def running_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of the label vectors."""
    return table(spark, sf_dir, "label_cache").select("source", "side", "volumes", tensors.running_counts(F.col("labels")).alias("seen"))


@query("running_events", "SELECT event_id, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events")
def running_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of each user up to each event."""
    e = table(spark, sf_dir, "events").withColumn("click", F.col("event_type") == "click")
    return tensors.running_count(e, "user_id", "event_id", "click").select("event_id", "seen")


@query("test_time_passes", "SELECT vec_id, i, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * (0.9 + 0.05 * i) + (-0.05 + 0.025 * i))), 5) AS s FROM embeddings, (SELECT unnest(range(0, 3)) AS i)")
def test_time_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the arrays under the scales and shifts of three test-time passes."""
    e = table(spark, sf_dir, "embeddings")
    each = [F.struct(F.lit(i).alias("i"), _scaled_sum(scale, shift).alias("s")) for i, (scale, shift) in enumerate(arrays.intensity_passes(3))]
    return e.select("vec_id", F.explode(F.array(*each)).alias("x")).select("vec_id", "x.i", F.round("x.s", 5).alias("s"))


def _scaled_sum(scale: float, shift: float):
    return F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * scale + shift)


@query("foreground_places", "SELECT source, side, volumes, list_position(labels, 1) - 1 AS first, len(labels) - list_position(list_reverse(labels), 1) AS last FROM label_cache WHERE list_contains(labels, 1)")
def foreground_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last place of each vector that is set."""
    f = table(spark, sf_dir, "label_cache").withColumn("f", tensors.foreground(F.col("labels"))).filter("f is not null")
    return f.select("source", "side", "volumes", "f.first", "f.last")


@query("resized_arrays", "SELECT vec_id, round(list_sum(list_transform(range(0, 16), lambda i: embedding[floor((i + 0.5) * len(embedding) / 16)::INT + 1]::DOUBLE)), 5) AS s FROM embeddings")
def resized_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays resampled to sixteen numbers, summed."""
    r = F.aggregate(tensors.resized(F.col("embedding"), 16), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(r, 5).alias("s"))


@query("proposer_table", f"""WITH f AS (SELECT * FROM (SELECT volume_name AS key, Pred_combined_report AS pred, row_number() OVER (PARTITION BY volume_name ORDER BY sample_id) AS r FROM predictions WHERE source = 'gen_alder') WHERE r = 1)
SELECT l.volumes AS key, l.labels, f.pred FROM label_cache l LEFT JOIN f ON f.key = l.volumes WHERE l.source = 'gen_alder' AND l.side = 'Pred'""")
def proposer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached labels of a source with its first text for each volume, null where it has none."""
    lab = label_vectors(spark, sf_dir, "Pred").filter("source = 'gen_alder'").select("key", "labels")
    texts = predictions(spark, sf_dir).filter("source = 'gen_alder'").select(F.col("volume_name").alias("key"), F.col("Pred_combined_report").alias("pred"), "sample_id")
    return align.proposer(lab, texts, "key", "sample_id")


_NAMES = "nm(idx, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(lexicon.LABELS)) + ")"


@query("score_lines", f"""WITH {_SINGLE}, {_NAMES}, l AS (SELECT *, {_F1} AS f1 FROM (SELECT *, {_PRF} FROM (SELECT idx, {_COUNTS} FROM pairs GROUP BY idx)))
SELECT printf('%-34s %9d', name, tp + fn) AS line FROM l JOIN nm USING (idx)""")
def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of each condition as lines of a text report."""
    names = F.array(*(F.lit(n) for n in lexicon.LABELS))
    s = classification.scored(classification.confusion(source_pairs(spark, sf_dir), ["idx"]))
    return s.select(F.format_string("%-34s %9d", F.element_at(names, (F.col("idx") + 1).cast("int")), "support").alias("line"))


@query("folder_keys", "SELECT DISTINCT split_part(image_path, '/', 2) AS split, left(md5('ct/' || split_part(image_path, '/', 2)), 8) AS folder_key FROM shard_index")
def folder_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the cached listings of folders."""
    split = F.element_at(F.split("image_path", "/"), 2)
    return table(spark, sf_dir, "shard_index").select(split.alias("split")).distinct().withColumn("folder_key", text.folder_key(F.concat(F.lit("ct/"), "split")))


def _seeded(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_MOVED = f"list_transform(range(1, len(embedding) + 1), lambda i: round(embedding[i]::DOUBLE * (1 + 0.1::DOUBLE * (2 * {_seeded(repr('7-scale'), 'vec_id')} - 1)) + 0.05::DOUBLE * (2 * {_seeded(repr('7-shift'), 'vec_id')} - 1) + 0.01::DOUBLE * (2 * {_seeded(repr('7-noise'), 'vec_id', 'i - 1')} - 1), 6) + 0.0::DOUBLE)"


@query("augmented_arrays", f"SELECT vec_id, CASE WHEN {_seeded(repr('7-flip'), 'vec_id')} < 0.5 THEN list_reverse(m) ELSE m END AS v FROM (SELECT vec_id, {_MOVED} AS m FROM embeddings)")
def augmented_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays with seeded changes of scale, shift, noise and direction."""
    v = tensors.augmented(F.transform("embedding", lambda x: x.cast("double")), F.col("vec_id"), 7)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(v, lambda x: F.round(x, 6) + 0.0).alias("v"))


@query("shuffled_regions", f"WITH {_LATEST} SELECT volume, list(region ORDER BY md5('3-' || volume || '-' || region)) AS area FROM latest WHERE region IN ({', '.join(f"'{r}'" for r in lexicon.REGIONS)}) GROUP BY volume")
def shuffled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of each volume in the order in which training takes them."""
    m = regions.maps(region_rows(spark, sf_dir).filter(F.col("region").isin(*lexicon.REGIONS)))
    return m.select("volume", regions.shuffled(F.map_keys("regions"), F.col("volume"), 3).alias("area"))


@query("shuffled_sentences", f"SELECT sample_id, array_to_string(list_transform(list_sort(list_transform(range(0, len(x)), lambda i: md5('4-' || sample_id || '-' || i) || x[i + 1])), lambda y: y[33:]), ' ') AS t FROM (SELECT sample_id, {_sentences("coalesce(GT_combined_report, '')", True)} AS x FROM predictions)")
def shuffled_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference reports with their sentences in random order."""
    return predictions(spark, sf_dir).select("sample_id", text.shuffled_sentences(F.col("GT_combined_report"), F.col("sample_id"), 4).alias("t"))


@query("ended_rows", f"SELECT sample_id, list_transform(range(0, 24), lambda i: CASE WHEN i < len(w) THEN w[i + 1] WHEN i = len(w) THEN 2 ELSE 0 END) AS ids FROM (SELECT sample_id, list_transform({_tokens('Question')}, lambda x: length(x)) AS w FROM predictions WHERE Question IS NOT NULL)")
def ended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows cut and padded to 24 tokens, with an end after the last one where there is room."""
    w = F.slice(F.transform(text.tokens(F.col("Question")), lambda x: F.length(x)), 1, 24)
    rows = predictions(spark, sf_dir).filter("Question is not null").select("sample_id", w.alias("w"))
    return rows.select("sample_id", arrays.ended(arrays.padded(F.col("w"), F.lit(24)), F.size("w"), 2).alias("ids"))


@query("cached_labels", "SELECT volumes, labels, source, side FROM label_cache")
def cached_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label cache written in one folder for each source and side, and read back."""
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    labels.write_cache(table(spark, sf_dir, "label_cache"), path)
    return spark.read.parquet(path).select("volumes", "labels", "source", "side")


@query("report_lines", f"""WITH {_SINGLE}, {_NAMES}, l AS (SELECT *, {_F1} AS f1 FROM (SELECT *, {_PRF} FROM (SELECT idx, {_COUNTS} FROM pairs GROUP BY idx)))
SELECT printf('%-34s %9.2f %9.2f %9.2f %9d', name, precision, recall, f1, tp + fn) AS line FROM l JOIN nm USING (idx)""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and support of each condition as lines of a text report."""
    names = F.array(*(F.lit(n) for n in lexicon.LABELS))
    s = classification.scored(classification.confusion(source_pairs(spark, sf_dir), ["idx"]))
    return classification.text_report(s.withColumn("name", F.element_at(names, (F.col("idx") + 1).cast("int"))), "name")


@query("shard_audit", "SELECT shard, count(*) AS members, 0::BIGINT AS skipped, NULL::VARCHAR AS error FROM shard_index GROUP BY shard")
def shard_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, skipped entries and damage of every shard."""
    folder = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    written = cut(shards.write_shards(table(spark, sf_dir, "shard_index").select("sample_idx", "shard", "image_path"), folder, "sample_idx", "shard"), "written")
    return shards.read_shards(spark, folder, audit="true").join(written.select("shard"), "shard")


@query("streamed_shards", "SELECT shard, sample_idx AS idx FROM shard_index")
def streamed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the shards as a stream takes them in."""
    at = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    shards.write_shards(table(spark, sf_dir, "shard_index").select("sample_idx", "shard", "image_path"), f"{at}/tar", "sample_idx", "shard").collect()  # one row a shard
    rows = shards.stream_shards(spark, f"{at}/tar").select("shard", "idx")
    rows.writeStream.format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/table")


@query("shard_members", "SELECT shard, sample_idx AS idx, image_path FROM shard_index")
def shard_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region maps written as tar shards and read back through the data source."""
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    index = table(spark, sf_dir, "shard_index").select("sample_idx", "shard", "image_path")
    write = shards.write_shards(index, folder, "sample_idx", "shard")
    written = cut(write, "written")
    back = shards.read_shards(spark, folder)
    path = F.get_json_object(F.col("content").cast("string"), "$.image_path")
    return back.join(written.select("shard"), "shard").select("shard", "idx", path.alias("image_path"))


# ---------------------------------------------------------------- seams and small files


@query("metrics_file", "SELECT Condition, Precision, Recall, F1 FROM condition_metrics")
def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the conditions written as CSV and read back; absent numbers stay null."""
    path = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    sinks.write_csv(table(spark, sf_dir, "condition_metrics").select("Condition", "Precision", "Recall", "F1"), path)
    return src.read_metrics(spark, path)


@query("appended_csv", "SELECT sample_id, count(*) AS n FROM (SELECT sample_id FROM predictions UNION ALL SELECT sample_id FROM predictions WHERE split = 'test') GROUP BY sample_id")
def appended_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to a CSV folder that holds others."""
    path = f"{shared_dir(spark)}/appended-{uuid.uuid4().hex}"
    rows = predictions(spark, sf_dir).select("sample_id", "volume_name", "GT_combined_report", "Pred_combined_report", "split")
    sinks.write_csv(rows.drop("split"), path)
    sinks.append_csv(rows.filter("split = 'test'").drop("split"), path)
    return src.read_csv(spark, path, schemas.PREDICTIONS_A).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


@query("training_texts", "SELECT GT_combined_report AS text FROM predictions WHERE GT_combined_report IS NOT NULL")
def training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second column where there is none of the known name, without nulls."""
    return src.training_texts(predictions(spark, sf_dir).select("sample_id", "GT_combined_report"))


def _lengths(texts: list[str]) -> list[list[float]]:
    """A stand-in for a classifier: probabilities from the length of a text."""
    return [[(len(t) + i) % 10 / 10 for i in range(18)] for t in texts]


@query("model_labels", "SELECT sample_id, list_transform(range(0, 18), lambda i: ((length(Pred_combined_report) + i) % 10 / 10.0::DOUBLE > 0.5)::INT) AS labels FROM predictions WHERE Pred_combined_report IS NOT NULL")
def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by a model that is called with batches of texts."""
    rows = predictions(spark, sf_dir).filter("Pred_combined_report is not null")
    return labels.model_labels(rows, "sample_id", "Pred_combined_report", _lengths)


@query("generated_texts", """SELECT sample_id, k::INT AS k, round(0.7::DOUBLE + 0.3::DOUBLE * k, 6) AS temperature, printf('%.1f ', 0.7 + 0.3 * k) || coalesce(Question, '') AS text FROM predictions, (SELECT unnest(range(0, 3)) AS k)""")
def generated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a generator at three temperatures, one for each question."""
    got = seams.generated(predictions(spark, sf_dir), "sample_id", "Question", lambda ps, t: [f"{t:.1f} {p}" for p in ps], seams.schedule(3))
    return got.withColumn("temperature", F.round("temperature", 6))


@query("model_scores", "SELECT sample_id, length(Question)::DOUBLE AS score FROM predictions")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model that is called with lists of texts."""
    got = seams.scored(predictions(spark, sf_dir).select("sample_id", "Question"), "Question", lambda ts: [float(len(t)) for t in ts])
    return got.select("sample_id", "score")


@query("token_rows", f"""SELECT sample_id, list_transform(range(1, 33), lambda i: CASE WHEN i <= len(w) THEN w[i] ELSE 0 END) AS ids, list_transform(range(1, 33), lambda i: (i <= len(w))::INT) AS mask
FROM (SELECT sample_id, list_transform(list_filter(string_split({_squeeze("coalesce(Question, '')")}, ' '), lambda x: x <> ''), lambda x: length(x)) AS w FROM predictions)""")
def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and masks of a tokenizer that is called text by text, cut and padded to 32."""
    return seams.tokenized(predictions(spark, sf_dir), "sample_id", "Question", lambda t: [len(w) for w in t.split()], 32)
