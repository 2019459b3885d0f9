"""Queries over the delivered tables, one per operator, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as q
from .functions import schema, text
from .functions.images import image_status
from .operators import analysis, dedup, embed, leakage, metrics, split, validate
from .plans import head, manifest, ml
from .plans.prepare import dataset_version, prepare, remediate_splits, with_ids
from .sources.readers import expected_counts, load_target, table
from .spread import spread
from .streaming.dedup import arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c) -> F.Column:
    return F.round(c, 6)


MOD, MM, PRED = "moderation_examples", "multimodal_examples", "predictions"
LABELS = schema.LABELS
_unit = lambda c: f"coalesce({c} >= 0 AND {c} <= 1 AND NOT isnan({c}), false)"
VALID = " AND ".join(
    [q.filled("text"), *[f"coalesce(length({c}) > 0, false)" for c in ("content_id", "source", "dataset_version")], *[_unit(f"labels.{n}") for n in LABELS]]
)
VALID_MM = " AND ".join(
    [q.filled("text"), "coalesce(split IN ('train', 'dev', 'test'), false)",
     *[f"coalesce(length({c}) > 0, false)" for c in ("example_id", "image_path", "source_img_path", "dataset_version")],
     "coalesce(hate_label BETWEEN 0 AND 1, false)", "coalesce(prop_label BETWEEN 0 AND 1, false)", "coalesce(hate_fine_grained_label BETWEEN 0 AND 9, false)"]
)
ARABIC = r"[\x{0600}-\x{06ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"


# scalar functions


@query(f"SELECT row_idx, left(sha256(text), 16) AS id FROM {MOD}")
def content_id(spark, d):
    return table(spark, d, MOD).select("row_idx", text.content_id(F.col("text")).alias("id"))


@query(f"SELECT row_idx, {q.normalize('text')} AS norm FROM {MOD}")
def normalize_text(spark, d):
    return spread(table(spark, d, MOD).select("row_idx", "text")).select("row_idx", text.normalize_text(F.col("text")).alias("norm"))


@query(
    f"""SELECT row_idx, text IS NOT NULL AS text_exists, {q.filled('text')} AS non_empty, {q.filled('text')} AND coalesce(contains(text, '�'), false) AS has_replacement_char,
    {q.filled('text')} AND coalesce(regexp_matches(text, '{ARABIC}'), false) AS contains_arabic,
    CASE WHEN text IS NULL THEN 'missing' WHEN NOT {q.filled('text')} THEN 'empty' END AS error FROM {MM}"""
)
def text_checks(spark, d):
    return table(spark, d, MM).select("row_idx", text.check_text(F.col("text")).alias("c")).select("row_idx", "c.*")


@query(
    f"""WITH t AS (SELECT row_idx, replace({q.strip('text')}, chr(10), ' ') AS line FROM {MOD})
    SELECT row_idx, CASE WHEN length(line) <= 100 THEN line ELSE regexp_replace(substring(line, 1, 100), '[{q.SPACE}]+$', '') || '...' END AS excerpt FROM t"""
)
def text_excerpts(spark, d):
    return table(spark, d, MOD).select("row_idx", text.excerpt(F.col("text")).alias("excerpt"))


@query(f"SELECT row_idx, left(sha256(example_id), 16) || '.jpg' AS file FROM {MM}")
def image_filenames(spark, d):
    return table(spark, d, MM).select("row_idx", text.image_filename(F.col("example_id")).alias("file"))


def _name_sql(column: str, names: tuple[str, ...]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"


@query(
    f"""SELECT row_idx, {_name_sql('hate_label', schema.HATE_NAMES)} AS hate, {_name_sql('prop_label', schema.PROP_NAMES)} AS prop,
    {_name_sql('hate_fine_grained_label', schema.FINE_NAMES)} AS fine FROM {MM}"""
)
def label_names(spark, d):
    name = schema.label_name
    return table(spark, d, MM).select(
        "row_idx", name(F.col("hate_label"), schema.HATE_NAMES).alias("hate"), name(F.col("prop_label"), schema.PROP_NAMES).alias("prop"),
        name(F.col("hate_fine_grained_label"), schema.FINE_NAMES).alias("fine"),
    )


@query(f"SELECT content_id AS id, labels.insult AS score, (SELECT max_by(dataset_version, row_idx) FROM {MOD}) AS dataset_version FROM {MOD}")
def target_rows(spark, d):
    return load_target(table(spark, d, MOD), "insult").select("id", "score", "dataset_version")


@query(f"SELECT source || '@' || split || ':0-' || count(*) AS version FROM {MOD} WHERE source IS NOT NULL GROUP BY source, split")
def dataset_versions(spark, d):
    per = table(spark, d, MOD).where("source IS NOT NULL").groupBy("source", "split").agg(F.count("*").alias("n"))
    return per.select(dataset_version(F.col("source"), F.col("split"), F.col("n")).alias("version"))


# contracts and validation


@query(f"SELECT row_idx FROM {MOD} WHERE {VALID}")
def contract_filter(spark, d):
    return table(spark, d, MOD).where(schema.valid_example()).select("row_idx")


@query(f"SELECT row_idx FROM {MM} WHERE {VALID_MM}")
def contract_filter_multimodal(spark, d):
    return table(spark, d, MM).where(schema.valid_multimodal()).select("row_idx")


_NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"


def _raw_status_sql() -> str:
    miss = " OR ".join(f"coalesce(json_type(j, '$.{f}'), 'NULL') = 'NULL'" for f in schema.RAW_FIELDS)
    isnum = lambda f: f"(json_type(j, '$.{f}') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') OR json_type(j, '$.{f}') = 'VARCHAR' AND regexp_matches(j->>'$.{f}', '{_NUM}'))"
    num = lambda f: f"(CASE json_type(j, '$.{f}') WHEN 'BOOLEAN' THEN CAST(CAST(j->>'$.{f}' AS BOOLEAN) AS DOUBLE) ELSE TRY_CAST(trim(j->>'$.{f}') AS DOUBLE) END)"
    bad_num = " OR ".join(f"NOT {isnum(f)}" for f in LABELS)
    bad_range = " OR ".join(f"NOT {_unit(num(f))}" for f in LABELS)
    return f"""WITH p AS (SELECT row_idx, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM raw_rows)
    SELECT row_idx, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'malformed' WHEN {miss} THEN 'malformed' WHEN json_type(j, '$.text') <> 'VARCHAR' THEN 'malformed'
    WHEN {bad_num} THEN 'malformed' WHEN NOT {q.filled("(j->>'$.text')")} OR {bad_range} THEN 'invalid' ELSE 'valid' END AS status FROM p"""


RAW_STATUS = _raw_status_sql()


@query(RAW_STATUS)
def raw_status(spark, d):
    return validate.classify_raw(table(spark, d, "raw_rows")).select("row_idx", "status")


@query(
    f"SELECT count(*) AS total_rows, count(*) FILTER (status = 'valid') AS valid_rows, count(*) FILTER (status = 'malformed') AS malformed_rows, count(*) FILTER (status = 'invalid') AS invalid_rows FROM ({RAW_STATUS})"
)
def validation_report_counts(spark, d):
    return validate.status_counts(validate.classify_raw(table(spark, d, "raw_rows")))


@query(f"SELECT row_idx FROM ({RAW_STATUS}) WHERE status = 'malformed' ORDER BY row_idx LIMIT 20")
def first20_malformed(spark, d):
    return validate.first_examples(validate.classify_raw(table(spark, d, "raw_rows")), "malformed").select("row_idx")


@query(f"SELECT row_idx FROM ({RAW_STATUS}) WHERE status = 'invalid' ORDER BY row_idx LIMIT 20")
def first20_invalid(spark, d):
    return validate.first_examples(validate.classify_raw(table(spark, d, "raw_rows")), "invalid").select("row_idx")


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS label, round(coalesce(avg(labels.{n}), 0), 6) AS mean, round(coalesce(avg(CASE WHEN labels.{n} >= 0.5 THEN 1.0 ELSE 0.0 END), 0), 6) AS fraction_ge_half FROM {MOD} WHERE {VALID}"
        for n in LABELS
    )
)
def label_distribution(spark, d):
    out = validate.label_distribution(table(spark, d, MOD).where(schema.valid_example()))
    return out.select("label", r6("mean").alias("mean"), r6("fraction_ge_half").alias("fraction_ge_half"))


@query(
    f"""SELECT split, count(*) FILTER (hate_label = 0) AS not_hateful, count(*) FILTER (hate_label = 1) AS hateful, count(*) AS total,
    round(avg(hate_label), 6) AS positive_rate FROM {MM} WHERE {VALID_MM} GROUP BY split"""
)
def label_distribution_multimodal(spark, d):
    out = validate.hate_distribution(table(spark, d, MM).where(schema.valid_multimodal()))
    return out.withColumn("positive_rate", r6("positive_rate"))


# the frame header of a JPEG, segment by segment: marker and position, until a size marker or an end
_BYTE = lambda at: f"CAST('0x' || substr(h, 2 * ({at}) + 1, 2) AS INT)"
IMAGE_STATUS = f"""WITH RECURSIVE b AS (SELECT path, hex(content) AS h, octet_length(content) AS n FROM image_blobs),
    w AS (SELECT path, h, n, 2 AS pos FROM b WHERE n >= 4 AND h LIKE 'FFD8%' UNION ALL
      SELECT path, h, n, pos + CASE WHEN {_BYTE('pos + 1')} = 255 THEN 1 ELSE 2 + 256 * {_BYTE('pos + 2')} + {_BYTE('pos + 3')} END FROM w
      WHERE pos + 9 <= n AND {_BYTE('pos')} = 255 AND NOT ({_BYTE('pos + 1')} BETWEEN 192 AND 207 AND {_BYTE('pos + 1')} NOT IN (196, 200, 204))),
    f AS (SELECT DISTINCT path FROM w WHERE pos + 9 <= n AND {_BYTE('pos')} = 255 AND {_BYTE('pos + 1')} BETWEEN 192 AND 207 AND {_BYTE('pos + 1')} NOT IN (196, 200, 204)
      AND substr(h, 2 * pos + 11, 4) <> '0000' AND substr(h, 2 * pos + 15, 4) <> '0000')
    SELECT path, CASE WHEN h IS NULL THEN 'missing' WHEN path IN (SELECT path FROM f) THEN 'ok' ELSE 'corrupted' END AS status FROM b"""


@query(
    f"""WITH RECURSIVE s AS ({IMAGE_STATUS}), r AS (SELECT m.*, {VALID_MM} AS ok, {q.filled('text')} AS full_text, {q.filled('text')} AND coalesce(regexp_matches(text, '{ARABIC}'), false) AS ar,
      {q.filled('text')} AND coalesce(contains(text, '�'), false) AS rep, coalesce(b.status, 'missing') AS image
      FROM {MM} m LEFT JOIN s b ON b.path = m.image_path WHERE split IN ('train', 'dev', 'test'))
    SELECT split AS split_name, count(*) AS total_rows, count(*) FILTER (ok) AS valid_rows, count(*) FILTER (NOT ok) AS malformed_rows, count(*) FILTER (NOT full_text OR rep) AS text_issues,
      round(avg(CAST(ar AS DOUBLE)), 6) AS arabic_fraction, count(*) FILTER (ok AND image = 'ok') AS images_ok, count(*) FILTER (ok AND image = 'corrupted') AS images_corrupted, count(*) FILTER (ok AND image = 'missing') AS images_missing,
      round(coalesce(avg(CASE WHEN ok THEN hate_label END), 0), 6) AS positive_rate FROM r GROUP BY ROLLUP (split)"""
)
def multimodal_report(spark, d):
    out = validate.multimodal_report(table(spark, d, MM), table(spark, d, "image_blobs"))
    return out.withColumns({c: r6(c) for c in ("arabic_fraction", "positive_rate")})


@query(IMAGE_STATUS)
def image_checks(spark, d):
    return table(spark, d, "image_blobs").select("path", image_status(F.col("content")).alias("status"))


@query(
    f"SELECT split, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM (VALUES ('train', 6000), ('dev', 1000), ('test', 2000)) e(split, expected) FULL JOIN (SELECT split, count(*) AS actual FROM {MM} WHERE split IS NOT NULL GROUP BY split) USING (split)"
)
def expected_vs_actual(spark, d):
    return expected_counts(table(spark, d, MM).where("split IS NOT NULL"), {"train": 6000, "dev": 1000, "test": 2000})


# duplicates


@query(f"SELECT row_idx FROM (SELECT row_idx, row_number() OVER (PARTITION BY left(sha256(text), 16) ORDER BY row_idx) AS rn FROM {MOD} WHERE text IS NOT NULL) WHERE rn = 1")
def exact_dedup_keep_first(spark, d):
    rows = with_ids(table(spark, d, MOD).where("text IS NOT NULL"))
    return dedup.keep_first(rows, "content_id").select("row_idx")


@query(
    f"SELECT row_idx, id, first_row FROM (SELECT row_idx, left(sha256(text), 16) AS id, min(row_idx) OVER (PARTITION BY left(sha256(text), 16)) AS first_row FROM {MOD} WHERE text IS NOT NULL) WHERE row_idx <> first_row"
)
def duplicates_removed(spark, d):
    rows = with_ids(table(spark, d, MOD).where("text IS NOT NULL"))
    return dedup.removed_duplicates(rows, "content_id").select("row_idx", F.col("content_id").alias("id"), "first_row")


# rounds: a row with no earlier undecided row of its id or text stays (1); then undecided rows that share one with a row that stays go (2)
@query(
    f"""WITH RECURSIVE k AS (SELECT row_idx, CASE WHEN content_id IS NOT NULL THEN hash(content_id) END AS a, CASE WHEN text IS NOT NULL THEN hash(text) END AS b FROM {MOD}),
    e AS (SELECT x.row_idx AS late, y.row_idx AS early FROM k x JOIN k y ON x.a = y.a AND y.row_idx < x.row_idx UNION SELECT x.row_idx, y.row_idx FROM k x JOIN k y ON x.b = y.b AND y.row_idx < x.row_idx),
    t(row_idx, state, round) AS (SELECT row_idx, 0, 0 FROM k UNION ALL
      SELECT t.row_idx, CASE WHEN t.state <> 0 THEN t.state WHEN coalesce(m.gone, false) THEN 2 WHEN NOT coalesce(m.open, false) THEN 1 ELSE 0 END, t.round + 1
      FROM t LEFT JOIN (SELECT e.late, bool_or(u.state = 1) AS gone, bool_or(u.state = 0) AS open FROM e JOIN t u ON u.row_idx = e.early GROUP BY e.late) m ON m.late = t.row_idx
      WHERE t.round < 400 AND EXISTS (SELECT 1 FROM t WHERE state = 0))
    SELECT row_idx FROM t WHERE state = 1 AND round = (SELECT max(round) FROM t)"""
)
def greedy_dedup(spark, d):
    return dedup.greedy_keep(table(spark, d, MOD)).select("row_idx")


_NEAR = "SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS examples FROM (SELECT count(*) AS n FROM ({rows}) GROUP BY norm HAVING count(*) > 1)"


@query(_NEAR.format(rows=f"SELECT {q.normalize('text')} AS norm FROM {MOD} WHERE text IS NOT NULL"))
def near_dup_groups_raw(spark, d):
    return dedup.near_groups(table(spark, d, MOD))


@query(_NEAR.format(rows=f"SELECT {q.normalize('text')} AS norm FROM (SELECT DISTINCT text FROM {MOD} WHERE text IS NOT NULL)"))
def near_dup_groups_deduped(spark, d):
    return dedup.near_groups(dedup.keep_first(with_ids(table(spark, d, MOD).where("text IS NOT NULL")), "content_id"))


_KEYS = f"""SELECT m.split, m.example_id AS id, m.text AS txt, b.sha AS image, CASE WHEN m.text IS NOT NULL AND b.sha IS NOT NULL THEN sha256(m.text) || '|' || b.sha END AS pair
    FROM {MM} m LEFT JOIN (SELECT path, sha256(content) AS sha FROM image_blobs) b ON b.path = m.image_path"""


def _with_image_hash(spark, d) -> DataFrame:
    """Rows with the hash of their picture, computed once per blob."""
    sha = table(spark, d, "image_blobs").select(F.col("path").alias("image_path"), F.sha2("content", 256).alias("sha"))
    return table(spark, d, MM).join(sha, "image_path", "left")


def _four_keys() -> dict:
    return {"id": F.col("example_id"), "text": F.col("text"), "image": F.col("sha"), "pair": F.concat(F.sha2("text", 256), F.lit("|"), F.col("sha"))}


_LONG = " UNION ALL ".join(f"SELECT split, '{k}' AS kind, {c} AS value FROM k" for k, c in (("id", "id"), ("text", "txt"), ("image", "image"), ("pair", "pair")))


@query(f"WITH k AS ({_KEYS}) SELECT kind, value, count(*) AS n FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY kind, value HAVING count(*) > 1")
def multi_key_duplicates(spark, d):
    return dedup.key_duplicates(_with_image_hash(spark, d), _four_keys())


# leakage

_PAIRS = "SELECT DISTINCT a.split || '<->' || b.split AS pair, a.kind, a.value FROM l a JOIN l b ON a.kind = b.kind AND a.value = b.value AND a.o < b.o"
_ORD = "CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 WHEN 'validation' THEN 1 WHEN 'test' THEN 2 END"
LEAKS = f"WITH k AS ({_KEYS}), l AS (SELECT DISTINCT split, {_ORD} AS o, kind, value FROM ({_LONG}) WHERE value IS NOT NULL AND value <> '' AND split IN ('train', 'dev', 'test')) {_PAIRS}"


@query(LEAKS)
def leakage_overlaps(spark, d):
    return leakage.overlaps(_with_image_hash(spark, d), _four_keys(), schema.SPLITS)


@query(f"SELECT count(*) = 0 AS is_clean, count(*) AS n_overlaps FROM ({LEAKS})")
def leakage_is_clean(spark, d):
    return leakage.is_clean(leakage_overlaps(spark, d))


_T_LONG = f"SELECT split, 'id' AS kind, content_id AS value FROM {MOD} UNION ALL SELECT split, 'text' AS kind, {q.normalize('text')} AS value FROM {MOD}"


@query(f"WITH l AS (SELECT DISTINCT split, {_ORD} AS o, kind, value FROM ({_T_LONG}) WHERE value IS NOT NULL AND value <> '' AND split IN ('train', 'validation', 'test')) {_PAIRS}")
def leakage_overlaps_text(spark, d):
    keys = {"id": F.col("content_id"), "text": text.normalize_text(F.col("text"))}
    return leakage.overlaps(table(spark, d, MOD), keys, ("train", "validation", "test"))


_BANNED = f"(SELECT text FROM {MM} WHERE split IN ('dev', 'test') AND text IS NOT NULL)"


@query(f"SELECT row_idx FROM {MM} WHERE split = 'train' AND (text IS NULL OR text NOT IN {_BANNED})")
def remediate_kept(spark, d):
    return leakage.remediate(table(spark, d, MM))[0].select("row_idx")


@query(f"SELECT row_idx FROM {MM} WHERE split = 'train' AND text IN {_BANNED}")
def remediate_removed(spark, d):
    return leakage.remediate(table(spark, d, MM))[1].select("row_idx")


_TRAIN = f"SELECT count(*) AS original, count(*) FILTER (text IN {_BANNED}) AS removed FROM {MM} WHERE split = 'train'"


@query(f"SELECT original, removed, original - removed AS final FROM ({_TRAIN})")
def remediation_counts(spark, d):
    return leakage.remediation_counts(table(spark, d, MM))


@query(f"SELECT row_idx, split FROM {MM} WHERE split IN ('dev', 'test') OR split = 'train' AND (text IS NULL OR text NOT IN {_BANNED})")
def remediated_splits(spark, d):
    return remediate_splits(table(spark, d, MM)).select("row_idx", "split")


_RATE = lambda s: f"coalesce(avg(CASE WHEN split = '{s}' AND hate_label IN (0, 1) THEN hate_label::DOUBLE END), 0)"


@query(
    f"""WITH r AS (SELECT {_RATE('train')} AS a, {_RATE('dev')} AS b, {_RATE('test')} AS c FROM {MM})
    SELECT round(a, 6) AS train_positive_rate, round(b, 6) AS dev_positive_rate, round(c, 6) AS test_positive_rate, round(c - a, 6) AS absolute_difference,
    CASE WHEN a <> 0 THEN round(c / a, 6) ELSE 'inf'::DOUBLE END AS relative_ratio FROM r"""
)
def positive_rate_shift(spark, d):
    out = leakage.shift(table(spark, d, MM).where("hate_label IN (0, 1)"))
    return out.select(*[r6(c).alias(c) for c in out.columns])


# splitting

_GROUPS = f"""SELECT CASE WHEN n = '' THEN '__empty__' || row_idx ELSE n END AS group_key, CASE WHEN coalesce(max(tox), 0) >= 0.5 THEN 1 ELSE 0 END AS stratum
    FROM (SELECT row_idx, {q.normalize('text')} AS n, labels.toxicity AS tox FROM {MOD} WHERE text IS NOT NULL AND (labels.toxicity IS NULL OR NOT isnan(labels.toxicity))) GROUP BY 1"""
SPLITTED = f"""SELECT group_key, stratum, CASE WHEN rank <= floor(n * 0.7 + 0.5) THEN 'train' WHEN rank <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE) + 0.5) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(group_key || '|42'), group_key) AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM ({_GROUPS}))"""


def _scored(spark, d) -> DataFrame:
    tox = F.col("labels.toxicity")
    return table(spark, d, MOD).where(F.col("text").isNotNull() & (tox.isNull() | ~F.isnan(tox))).select("row_idx", "text", tox.alias("toxicity"))


@query(f"SELECT sha256(group_key) AS group_id, stratum, split FROM ({SPLITTED})")
def stratified_group_split(spark, d):
    return split.split_groups(_scored(spark, d)).select(F.sha2("group_key", 256).alias("group_id"), "stratum", "split")


@query(f"SELECT split, stratum, count(*) AS n_groups FROM ({SPLITTED}) GROUP BY split, stratum")
def split_sizes(spark, d):
    return split.split_groups(_scored(spark, d)).groupBy("split", "stratum").agg(F.count("*").alias("n_groups"))


# metrics

_P = f"(SELECT row_idx, y_true, fusion_p AS p FROM {PRED} WHERE y_true IS NOT NULL AND fusion_p IS NOT NULL)"


def _predictions(spark, d, column: str = "fusion_p") -> DataFrame:
    return table(spark, d, PRED).select("row_idx", "y_true", F.col(column).alias("y_prob"))


def _sweep_sql(column: str, thresholds: str) -> str:
    return f"""WITH c AS (SELECT t AS threshold, count(*) FILTER (y_true = 1 AND p >= t) AS tp, count(*) FILTER (y_true <> 1 AND p >= t) AS fp, count(*) FILTER (y_true = 1 AND p < t) AS fn,
      count(*) FILTER (y_true <> 1 AND p < t) AS tn FROM (SELECT y_true, {column} AS p FROM {PRED} WHERE y_true IS NOT NULL AND {column} IS NOT NULL), (SELECT unnest({thresholds})::DOUBLE AS t) GROUP BY t),
    m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc,
      CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0 * tn / (2 * tn + fp + fn) ELSE 0 END AS f0 FROM c)
    SELECT threshold, tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive, tp + fp + fn + tn AS n, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
      round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, round((f1 + f0) / 2, 6) AS macro_f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS false_positive_rate,
      round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS false_negative_rate, round((tp + fp) / (tp + fp + fn + tn), 6) AS positive_prediction_rate FROM m"""


SWEEP = _sweep_sql("fusion_p", str(list(metrics.THRESHOLDS)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c in metrics.NAMES})


@query(_sweep_sql("fusion_p", "[0.5]"))
def confusion_metrics(spark, d):
    return _rounded(metrics.threshold_metrics(_predictions(spark, d), (0.5,)))


@query(SWEEP)
def threshold_sweep(spark, d):
    return _rounded(metrics.threshold_metrics(_predictions(spark, d)))


@query(f"SELECT threshold, f1 FROM ({SWEEP}) ORDER BY f1 DESC, threshold LIMIT 1")
def select_threshold(spark, d):
    return metrics.select_threshold(_rounded(metrics.threshold_metrics(_predictions(spark, d))))


_CURVE = f"""SELECT p, tp, fp, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER () AS pos, sum(fp) OVER () AS neg
    FROM (SELECT p, count(*) FILTER (y_true = 1) AS tp, count(*) FILTER (y_true <> 1) AS fp FROM {_P} GROUP BY p) WINDOW w AS (ORDER BY p DESC)"""


@query(f"SELECT round(sum(tp * ctp / (ctp + cfp)) / max(pos), 6) AS pr_auc FROM ({_CURVE})")
def pr_auc(spark, d):
    return metrics.areas(_predictions(spark, d)).select(r6("pr_auc").alias("pr_auc"))


@query(f"SELECT round(sum(fp * (ctp - tp / 2)) / (max(pos) * max(neg)), 6) AS roc_auc FROM ({_CURVE})")
def roc_auc(spark, d):
    return metrics.areas(_predictions(spark, d)).select(r6("roc_auc").alias("roc_auc"))


@query(f"SELECT p AS score, round(ctp / (ctp + cfp), 6) AS precision, round(ctp / pos, 6) AS recall FROM ({_CURVE})")
def pr_curve_points(spark, d):
    out = metrics.precision_recall_points(_predictions(spark, d))
    return out.select("score", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(
    f"SELECT round((a + b) / (2 * greatest(a, 1)), 6) AS weight_0, round((a + b) / (2 * greatest(b, 1)), 6) AS weight_1 FROM (SELECT count(*) FILTER (y_true = 0) AS a, count(*) FILTER (y_true = 1) AS b FROM {PRED})"
)
def class_weights(spark, d):
    out = metrics.class_weights(_predictions(spark, d))
    return out.select(r6("weight_0").alias("weight_0"), r6("weight_1").alias("weight_1"))


@query(f"SELECT row_idx, y_true, p, CAST(p >= 0.5 AS INT) AS label, CAST((p >= 0.5) = (y_true = 1) AS INT) AS correct FROM {_P}")
def binarize_predict(spark, d):
    label = metrics.at_least(F.col("y_prob"), 0.5)
    rows = _predictions(spark, d).where("y_true IS NOT NULL AND y_prob IS NOT NULL")
    return rows.select("row_idx", "y_true", F.col("y_prob").alias("p"), label.alias("label"), (label == F.col("y_true")).cast("int").alias("correct"))


@query(
    "WITH a AS ({a}), b AS ({b}), x AS ({long_a}), y AS ({long_b}) SELECT x.metric, x.v AS baseline, y.v AS candidate, round(y.v - x.v, 6) AS absolute, CASE WHEN x.v <> 0 THEN round((y.v - x.v) / x.v, 6) ELSE 'nan'::DOUBLE END AS relative FROM x JOIN y USING (metric)".format(
        a=_sweep_sql("text_p", "[0.5]"), b=_sweep_sql("fusion_p", "[0.5]"),
        long_a=" UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS v FROM a" for m in metrics.NAMES), long_b=" UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS v FROM b" for m in metrics.NAMES),
    )
)
def metric_comparison(spark, d):
    one = lambda c: _rounded(metrics.threshold_metrics(_predictions(spark, d, c), (0.5,)))
    out = metrics.compare(one("text_p"), one("fusion_p"))
    return out.withColumns({c: r6(c) for c in ("absolute", "relative")})


@query(
    f"""SELECT kind, row_idx, y_true, p FROM ((SELECT 'false_positive' AS kind, * FROM (SELECT DISTINCT * FROM {_P}) WHERE y_true = 0 AND p >= 0.5 ORDER BY p DESC, row_idx LIMIT 5)
    UNION ALL (SELECT 'false_negative' AS kind, * FROM (SELECT DISTINCT * FROM {_P}) WHERE y_true = 1 AND p < 0.5 ORDER BY p, row_idx LIMIT 5))"""
)
def error_topk_fp_fn(spark, d):
    rows = _predictions(spark, d).where("y_true IS NOT NULL AND y_prob IS NOT NULL").distinct()
    return analysis.worst_errors(rows).select("kind", "row_idx", "y_true", F.col("y_prob").alias("p"))


_RIGHT = f"""SELECT (text_p >= 0.5) = (y_true = 1) AS t, (image_p >= 0.5) = (y_true = 1) AS i, (fusion_p >= 0.5) = (y_true = 1) AS f FROM {PRED}
    WHERE y_true IS NOT NULL AND text_p IS NOT NULL AND image_p IS NOT NULL AND fusion_p IS NOT NULL"""


@query(
    f"""SELECT count(*) AS n, count(*) FILTER (NOT t AND NOT i AND f) AS text_wrong_image_wrong_fusion_correct, count(*) FILTER (t AND NOT i AND NOT f) AS text_correct_image_wrong_fusion_wrong,
    count(*) FILTER (i AND NOT t AND NOT f) AS image_correct_text_wrong_fusion_wrong, count(*) FILTER (t AND i AND f) AS all_three_correct, count(*) FILTER (NOT t AND NOT i AND NOT f) AS all_three_wrong,
    round(avg(t::INT), 6) AS text_accuracy, round(avg(i::INT), 6) AS image_accuracy, round(avg(f::INT), 6) AS fusion_accuracy FROM ({_RIGHT})"""
)
def complementarity_counts(spark, d):
    out = analysis.complementarity(table(spark, d, PRED))
    return out.withColumns({f"{m}_accuracy": r6(f"{m}_accuracy") for m in ("text", "image", "fusion")})


@query(
    f"""SELECT row_idx, CASE WHEN NOT t AND NOT i AND f THEN '{analysis.OUTCOMES[0]}' WHEN t AND NOT i AND NOT f THEN '{analysis.OUTCOMES[1]}' ELSE '{analysis.OUTCOMES[2]}' END AS outcome
    FROM ({_RIGHT.replace('SELECT', 'SELECT row_idx,', 1)}) WHERE NOT t AND NOT i AND f OR t AND NOT i AND NOT f OR i AND NOT t AND NOT f"""
)
def complementarity_rows(spark, d):
    return analysis.outcome_rows(table(spark, d, PRED))


@query(
    f"""WITH e AS (SELECT kind, row_idx, p FROM ((SELECT 'false_positive' AS kind, * FROM (SELECT DISTINCT * FROM {_P}) WHERE y_true = 0 AND p >= 0.5 ORDER BY p DESC, row_idx LIMIT 5)
      UNION ALL (SELECT 'false_negative' AS kind, * FROM (SELECT DISTINCT * FROM {_P}) WHERE y_true = 1 AND p < 0.5 ORDER BY p, row_idx LIMIT 5))),
    t AS (SELECT row_idx, image_path, replace({q.strip('text')}, chr(10), ' ') AS line FROM {MM})
    SELECT kind, row_idx, p, image_path, CASE WHEN length(line) <= 100 THEN line ELSE regexp_replace(substring(line, 1, 100), '[{q.SPACE}]+$', '') || '...' END AS excerpt FROM e LEFT JOIN t USING (row_idx)"""
)
def error_topk_with_text_and_image(spark, d):
    rows = table(spark, d, MM).select("row_idx", "image_path", text.excerpt(F.col("text")).alias("excerpt"))
    return error_topk_fp_fn(spark, d).drop("y_true").join(rows, "row_idx", "left")


@query(
    "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(1000 / avg(value), 6) AS per_second, count(value) AS n FROM events"
)
def latency_percentiles(spark, d):
    out = analysis.latency_summary(table(spark, d, "events"), "value")
    return out.select(*[r6(c).alias(c) for c in ("p50", "p95", "p99", "mean", "per_second")], "n")


# embeddings: the first half stands for text, the second for the image


def _halves(spark, d) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.slice(e, 1, 32).alias("text_emb"), F.slice(e, 33, 32).alias("image_emb"))


@query("SELECT vec_id AS id, i AS pos, embedding[i + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS i)")
def fuse_embeddings(spark, d):
    rows = _halves(spark, d)
    fused = embed.fuse(rows.select("id", "text_emb"), rows.select("id", "image_emb"))
    return fused.select("id", F.posexplode("fused").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


@query("SELECT i AS pos, round(avg(embedding[i + 1]::DOUBLE), 6) AS mean FROM embeddings, (SELECT unnest(range(32)) AS i) WHERE label < 7 GROUP BY i")
def modality_means(spark, d):
    out = embed.element_means(_halves(spark, d).where("label < 7"), "text_emb")
    return out.select(F.col("pos").cast("long").alias("pos"), r6("mean").alias("mean"))


@query(
    """WITH m AS (SELECT i, avg(embedding[i + 1]::DOUBLE) AS mean FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE label < 7 GROUP BY i)
    SELECT vec_id AS id, i AS pos, round(CASE WHEN i < 32 THEN mean ELSE embedding[i + 1]::DOUBLE END, 6) AS x FROM embeddings, m WHERE label >= 7"""
)
def ablation_inputs(spark, d):
    rows = _halves(spark, d)
    out = embed.without_modality(rows.where("label >= 7"), rows.where("label < 7"), keep="image")
    return out.select("id", F.posexplode("fused").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


@query("SELECT vec_id AS id, round(1 / (1 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)), 6) AS p FROM embeddings")
def softmax_probability(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), r6(embed.positive_probability(e[0].cast("double"), e[1].cast("double"))).alias("p"))


@query("SELECT vec_id AS id, round((embedding[1]::DOUBLE + embedding[3]::DOUBLE) / 2, 6) AS x FROM embeddings")
def masked_mean_pooling(spark, d):
    e = F.col("embedding")
    tokens, mask = F.array(*[F.slice(e, k, 1) for k in (1, 2, 3)]), F.array(F.lit(1), F.lit(0), F.lit(1))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), r6(embed.masked_mean(tokens, mask)[0]).alias("x"))


@query()
def head_scores(spark, d):
    rows = _halves(spark, d).withColumn("y", (F.col("label") >= 5).cast("int")).withColumn("fused", F.concat("text_emb", "image_emb"))
    x, y = head.collect_rows(rows.where("label <> 9 AND label <> 0"), "fused", "y")
    dev_x, dev_y = head.collect_rows(rows.where("label IN (0, 9)"), "fused", "y")
    model = head.train_head(x, y, dev_x, dev_y, head.HeadConfig(hidden=32, epochs=10))
    return head.score(rows, model).select("id", r6("probability").alias("probability"))


# hashes, model, stream


@query(f"SELECT sha256(string_agg(coalesce(content_id, '') || '|' || coalesce(text, ''), chr(10) ORDER BY coalesce(content_id, ''), coalesce(text, ''))) AS content_hash FROM {MOD}")
def dataset_content_hash(spark, d):
    return spark.createDataFrame([(manifest.content_hash(table(spark, d, MOD)),)], "content_hash string")


_BITS = "('0x' || left(sha256(coalesce(content_id, '') || '|' || coalesce(text, '')), 15))::BIGINT"


@query(f"SELECT count(*) AS n, bit_xor({_BITS}) AS xor, CAST(sum({_BITS}::HUGEINT) AS VARCHAR) AS total FROM {MOD}")
def folded_content_hash(spark, d):
    return manifest.folded_hash(table(spark, d, MOD))


@query(
    f"SELECT 'split:' || coalesce(split, '') AS key, count(*)::DOUBLE AS value FROM {MOD} GROUP BY split UNION ALL SELECT 'num_records', count(*)::DOUBLE FROM {MOD} UNION ALL "
    + " UNION ALL ".join(f"SELECT 'share:{n}', round(coalesce(avg(CASE WHEN labels.{n} >= 0.5 THEN 1.0 WHEN labels.{n} IS NOT NULL THEN 0.0 END), 0), 6) FROM {MOD}" for n in LABELS)
)
def text_manifest_counts(spark, d):
    return manifest.manifest_counts(table(spark, d, MOD)).withColumn("value", r6("value"))


@query(
    f"""WITH k AS ({_KEYS}), dup AS (SELECT kind FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY kind, value HAVING count(*) > 1), leak AS ({LEAKS}), r AS ({_TRAIN})
    SELECT 'duplicates:' || kind AS key, count(*) AS value FROM dup GROUP BY kind UNION ALL SELECT 'overlaps:' || pair || ':' || kind, count(*) FROM leak GROUP BY pair, kind
    UNION ALL SELECT 'original', original FROM r UNION ALL SELECT 'removed', removed FROM r UNION ALL SELECT 'final', original - removed FROM r"""
)
def multimodal_manifest_counts(spark, d):
    return manifest.multimodal_counts(multi_key_duplicates(spark, d), leakage_overlaps(spark, d), leakage.remediation_counts(table(spark, d, MM)))


_TERMS = f"""WITH w AS (SELECT row_idx, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {MOD} WHERE split = 'train' AND text IS NOT NULL),
    t AS (SELECT row_idx, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
    c AS (SELECT row_idx, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM w)
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(ln((1.0 + max(n)) / (1.0 + count(*))) + 1, 6) AS idf FROM c, n GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * max(n)
    ORDER BY cf DESC, term LIMIT 20000"""


def _train_docs(spark, d) -> DataFrame:
    return table(spark, d, MOD).where("text IS NOT NULL").select(F.col("row_idx").alias("id"), "text", "split", F.when(F.col("labels.toxicity").between(0, 1), metrics.at_least(F.col("labels.toxicity"), 0.5)).alias("y"))


@query(_TERMS)
def tfidf_vocabulary(spark, d):
    out = ml.vocabulary(_train_docs(spark, d).where("split = 'train'").select("id", "text"))
    return out.select("term", "df", "cf", r6("idf").alias("idf"))


@query()
def tfidf_lr_predict(spark, d):
    docs = _train_docs(spark, d)
    model = ml.fit(docs.where("split = 'train' AND y IS NOT NULL").select("id", "text", "y"))
    return ml.predict(model, docs.where("split = 'test'").select("id", "text")).select("id", r6("probability").alias("probability"), "label")


@query(f"SELECT date_trunc('day', ingested_at) AS day, source, count(*) AS n FROM {MOD} GROUP BY ALL")
def arrivals_per_day(spark, d):
    return arrivals(table(spark, d, MOD)).select(F.col("w.start").alias("day"), "source", "n")
