"""DuckDB SQL text for the oracle check: the fixture recipes and shared expressions.

These strings restate, in plain SQL, what the Spark operators compute, so the
driver can compare both engines on the same parquet tables.
"""

from __future__ import annotations

from ..constants import TRIGGER_TERMS
from ..sources.fixtures import (
    CLASSICAL_CUTS,
    DATASET_EVEN,
    DATASET_ODD,
    MESSY_LABEL_SQL,
    MESSY_REASONS_SQL,
    MESSY_TEXT_SQL,
    NEURAL_CUTS,
    TEXT_LABEL_SQL,
    VARIANTS,
    _sql_str,
    dataset_sql,
    injected_text_sql,
)
from ..constants import SEEDS

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WS_RUN = WS + "+"
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def word_len_sql(t: str) -> str:
    return f"len(list_filter(regexp_split_to_array({t}, '{WS_RUN}'), lambda x: x <> ''))"


def strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^{WS_RUN}|{WS_RUN}$', '', 'g')"


def forms(t: str) -> list[str]:
    return [t, t.capitalize(), t.upper()]


def mask_sql(t: str, token: str = "[TRIGGER]") -> str:
    out = t
    for term in TRIGGER_TERMS:
        for f in forms(term):
            out = f"replace({out}, {_sql_str(f)}, {_sql_str(token)})"
    return out


def remove_sql(t: str) -> str:
    out = t
    for term in TRIGGER_TERMS:
        for f in forms(term):
            out = f"replace({out}, {_sql_str(f)}, ' ')"
    return f"array_to_string(list_filter(regexp_split_to_array({out}, '{WS_RUN}'), lambda x: x <> ''), ' ')"


def hit_sql(t: str, term: str) -> str:
    return "(" + " OR ".join(f"contains({t}, {_sql_str(f)})" for f in forms(term)) + ")"


def reasons_sql(t: str) -> str:
    parts = ", ".join(f"CASE WHEN {hit_sql(t, term)} THEN {_sql_str(term)} END" for term in TRIGGER_TERMS)
    return f"nullif(concat_ws(',', {parts}), '')"


def parse_reasons_sql(r: str) -> str:
    return (
        f"list_filter(list_transform(string_split(coalesce({r}, ''), ','), lambda x: {strip_sql('x')}), "
        f"lambda x: x <> '')"
    )


MESSY = f"""
messy AS (
  SELECT {dataset_sql('d.source')} AS dataset, {MESSY_TEXT_SQL.replace('doc_id', 'd.doc_id')} AS requirement_text,
         {MESSY_LABEL_SQL.format(text='VARCHAR').replace('doc_id', 'd.doc_id')} AS label, {MESSY_REASONS_SQL.replace('doc_id', 'd.doc_id')} AS reasons
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN (VALUES (1), (2)) c(copy) ON c.copy = 1 OR d.doc_id % 10 = 0
)"""


def safe_float_sql(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '^[ \\t\\n\\r\\f\\x0b]*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?[ \\t\\n\\r\\f\\x0b]*$') "
            f"THEN CAST(trim({x}) AS DOUBLE) END")


def clean_label_sql(x: str) -> str:
    return f"CAST(coalesce(trunc({safe_float_sql(x)}), 0) AS BIGINT)"


REQ_PLAIN = f"""
req_plain AS (
  SELECT d.doc_id AS req_id, {dataset_sql('d.source')} AS dataset, d.text AS requirement_text,
         CAST(1 - l.quality AS INTEGER) AS label, CAST(NULL AS VARCHAR) AS reasons
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""

REQ = (
    REQ_PLAIN
    + f""",
req_inj AS (
  SELECT req_id, dataset, {injected_text_sql('req_id', 'requirement_text')} AS requirement_text, label
  FROM req_plain
),
req AS (
  SELECT req_id, dataset, requirement_text, label, {reasons_sql('requirement_text')} AS reasons FROM req_inj
)"""
)


def grid_values(cuts: dict[str, str] | None = None) -> str:
    cuts = cuts or {**CLASSICAL_CUTS, **NEURAL_CUTS}
    rows = []
    for m, c in cuts.items():
        vs = VARIANTS if m in CLASSICAL_CUTS else VARIANTS[:1]
        rows += [f"({_sql_str(m)}, {_sql_str(c)}, {s}, {_sql_str(v)})" for s in SEEDS for v in vs]
    return "(VALUES " + ", ".join(rows) + ") AS g(model, cut, seed, variant)"


INSTANCES = (
    REQ
    + f""",
req_settings AS (
  SELECT req_id, 'intra' AS setting, dataset AS train_dataset, dataset AS test_dataset, requirement_text, label, reasons FROM req
  UNION ALL
  SELECT req_id, 'cross' AS setting,
         CASE WHEN dataset = '{DATASET_EVEN}' THEN '{DATASET_ODD}' ELSE '{DATASET_EVEN}' END AS train_dataset,
         dataset AS test_dataset, requirement_text, label, reasons FROM req
),
instances AS (
  SELECT r.setting, g.variant, r.train_dataset, r.test_dataset, g.model, CAST(g.seed AS INTEGER) AS seed, r.req_id,
         r.requirement_text AS text, CAST(r.label AS INTEGER) AS y_true,
         CAST(CASE WHEN substr(md5(concat_ws(':', g.model, CAST(g.seed AS VARCHAR), CAST(r.req_id AS VARCHAR), r.setting, g.variant)), 1, 2) < g.cut
              THEN 1 - r.label ELSE r.label END AS INTEGER) AS y_pred,
         r.reasons
  FROM req_settings r CROSS JOIN {grid_values()}
)"""
)


def confusion_sql(t: str = "y_true", p: str = "y_pred") -> str:
    return (
        f"CAST(count_if({t} = 0 AND {p} = 0) AS BIGINT) AS tn, CAST(count_if({t} = 0 AND {p} = 1) AS BIGINT) AS fp, "
        f"CAST(count_if({t} = 1 AND {p} = 0) AS BIGINT) AS fn, CAST(count_if({t} = 1 AND {p} = 1) AS BIGINT) AS tp"
    )


def metrics_sql(prefix: str = "", digits: int | None = 6) -> str:
    """The seven metrics from tn/fp/fn/tp columns (as DOUBLE), rounded."""
    tn, fp, fn, tp = (f"CAST({prefix}{c} AS DOUBLE)" for c in ("tn", "fp", "fn", "tp"))
    n = f"({tn} + {fp} + {fn} + {tp})"
    pos, neg = f"({tp} + {fn})", f"({tn} + {fp})"
    rp, rn = f"({tp} / nullif({pos}, 0))", f"({tn} / nullif({neg}, 0))"
    bal = f"CASE WHEN {pos} = 0 THEN {rn} WHEN {neg} = 0 THEN {rp} ELSE ({rp} + {rn}) / 2.0 END"
    prod = f"(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
    mcc = f"CASE WHEN {prod} = 0 THEN 0.0 ELSE ({tp} * {tn} - {fp} * {fn}) / sqrt({prod}) END"
    pe_num = f"(({tp} + {fn}) * ({tp} + {fp}) + ({tn} + {fp}) * ({tn} + {fn}))"
    po = f"(({tp} + {tn}) / nullif({n}, 0))"
    pe = f"({pe_num} / nullif({n} * {n}, 0))"
    kappa = f"CASE WHEN {pe_num} = {n} * {n} THEN NULL ELSE ({po} - {pe}) / (1.0 - {pe}) END"
    exprs = {
        "accuracy": f"({tp} + {tn}) / nullif({n}, 0)",
        "balanced_accuracy": bal,
        "precision": f"coalesce({tp} / nullif({tp} + {fp}, 0), 0.0)",
        "recall": f"coalesce({tp} / nullif({tp} + {fn}, 0), 0.0)",
        "f1": f"coalesce(2.0 * {tp} / nullif(2.0 * {tp} + {fp} + {fn}, 0), 0.0)",
        "mcc": mcc,
        "cohen_kappa": kappa,
    }
    if digits is None:
        return ", ".join(f"CAST({e} AS DOUBLE) AS {m}" for m, e in exprs.items())
    return ", ".join(f"round(CAST({e} AS DOUBLE), {digits}) AS {m}" for m, e in exprs.items())


METRIC_NAMES = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc", "cohen_kappa"]


RUN_KEYS = "setting, variant, train_dataset, test_dataset, model, seed"

RESULTS = (
    INSTANCES
    + f""",
runs AS (SELECT {RUN_KEYS}, {confusion_sql()}, count(*) AS n FROM instances GROUP BY {RUN_KEYS}),
results AS (SELECT {RUN_KEYS}, {metrics_sql(digits=None)}, tn, fp, fn, tp, n AS n_test FROM runs)"""
)


def summary_select(keys: str) -> str:
    aggs = ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in METRIC_NAMES)
    return f"SELECT {keys}, {aggs}"


def in_list(names) -> str:
    return "(" + ", ".join(_sql_str(n) for n in names) + ")"


def round_cols(cols) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


SUMMARY_COLS = [f"{m}_{s}" for m in METRIC_NAMES for s in ("mean", "std")]


def seeds_sql() -> str:
    return "seeds AS (SELECT unnest([" + ", ".join(str(s) for s in SEEDS) + "]) AS seed)"


def quota_sql(src: str, groups: str, test_size: float, name: str = "quotas") -> str:
    """Exact stratified test counts per (groups, label) of table ``src``."""
    return f"""{name}_c AS (SELECT {groups}, label, count(*) AS n_c FROM {src} GROUP BY ALL),
{name}_1 AS (SELECT *, sum(n_c) OVER (PARTITION BY {groups}) AS n FROM {name}_c),
{name}_2 AS (SELECT *, CAST(ceil(CAST({test_size} AS DOUBLE) * n) AS BIGINT) AS n_test FROM {name}_1),
{name}_3 AS (SELECT *, n - n_test AS n_train, CAST(n_c AS HUGEINT) * CAST(n - n_test AS HUGEINT) AS prod FROM {name}_2),
{name}_4 AS (SELECT *, prod // CAST(n AS HUGEINT) AS fl, prod % CAST(n AS HUGEINT) AS rem FROM {name}_3),
{name}_5 AS (SELECT *, n_train - sum(fl) OVER (PARTITION BY {groups}) AS need,
                    row_number() OVER (PARTITION BY {groups} ORDER BY rem DESC, label) AS rk FROM {name}_4),
{name} AS (SELECT {groups}, label, n_c, CAST(n_c - (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS BIGINT) AS test_c FROM {name}_5)"""


def split_sql(src: str, test_size: float, salt: str, name: str, test_name: str = "test", train_name: str = "train") -> str:
    """Rows of ``src`` (seed, dataset, req_id, label, ...) with a part column, exact per (seed, dataset, label)."""
    return f"""{quota_sql(src, 'seed, dataset', test_size, name + '_q')},
{name}_r AS (SELECT s.*, row_number() OVER (PARTITION BY seed, dataset, label
              ORDER BY md5(concat_ws(':', CAST(seed AS VARCHAR), '{salt}', CAST(req_id AS VARCHAR))), req_id) AS rn FROM {src} s),
{name} AS (SELECT r.seed, r.dataset, r.req_id, r.label, CASE WHEN r.rn <= q.test_c THEN '{test_name}' ELSE '{train_name}' END AS part
           FROM {name}_r r JOIN {name}_q q USING (seed, dataset, label))"""


SPLIT_BASE = (
    REQ
    + f""",
{seeds_sql()},
lab AS (SELECT req_id, dataset, label FROM req),
lab_seeds AS (SELECT l.*, s.seed FROM lab l CROSS JOIN seeds s),
{split_sql('lab_seeds', 0.2, '', 'split')}"""
)


def grams_sql(t: str) -> str:
    return (f"list_concat(tk, CASE WHEN len(tk) >= 2 THEN list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]) "
            f"ELSE []::VARCHAR[] END)")


TERMS_V = f"""variants AS (SELECT req_id, 'original' AS variant, requirement_text AS t FROM req
                UNION ALL SELECT req_id, 'masked_triggers', {mask_sql('requirement_text')} FROM req
                UNION ALL SELECT req_id, 'removed_triggers', {remove_sql('requirement_text')} FROM req),
toks AS (SELECT req_id, variant, regexp_extract_all(lower(t), '{TOKEN_RE}') AS tk FROM variants),
grams AS (SELECT req_id, variant, unnest({grams_sql('tk')}) AS term FROM toks),
terms_v AS (SELECT req_id, variant, term, CAST(count(*) AS INTEGER) AS cnt FROM grams GROUP BY ALL),
terms AS (SELECT req_id, term, cnt FROM terms_v WHERE variant = 'original')"""

NB = (
    SPLIT_BASE.replace("CAST(1 - l.quality AS INTEGER) AS label", f"CAST({TEXT_LABEL_SQL.replace('doc_id', 'd.doc_id')} AS INTEGER) AS label")
    + f""",
{TERMS_V},
train AS (SELECT dataset || ':' || CAST(seed AS VARCHAR) AS tset, req_id, label FROM split WHERE part = 'train'
          UNION ALL SELECT dataset || ':all', req_id, label FROM lab WHERE dataset IN ('{DATASET_EVEN}', '{DATASET_ODD}')),
ndocs AS (SELECT tset, count(*) AS n_docs FROM train GROUP BY tset),
dft AS (SELECT t.tset, x.term, count(*) AS df FROM train t JOIN terms x USING (req_id) GROUP BY ALL),
vocab AS (SELECT d.tset, d.term, d.df, n.n_docs,
                 ln(CAST(1 + n.n_docs AS DOUBLE) / CAST(1 + d.df AS DOUBLE)) + 1.0 AS idf
          FROM dft d JOIN ndocs n USING (tset) WHERE d.df >= 2 AND d.df <= CAST(0.95 AS DOUBLE) * n.n_docs),
trw AS (SELECT t.tset, t.req_id, x.term, (1.0 + ln(CAST(x.cnt AS DOUBLE))) * v.idf AS w
        FROM train t JOIN terms x USING (req_id) JOIN vocab v ON v.tset = t.tset AND v.term = x.term),
train_x AS (SELECT tset, req_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY tset, req_id)) AS x FROM trw),
nc AS (SELECT tset, label, count(*) AS n_c FROM train GROUP BY ALL),
vs AS (SELECT tset, count(*) AS v_size FROM vocab GROUP BY tset),
fc AS (SELECT x.tset, t.label, x.term, sum(x.x) AS fc FROM train_x x JOIN train t USING (tset, req_id) GROUP BY ALL),
tot AS (SELECT tset, label, sum(fc) AS total FROM fc GROUP BY ALL),
cls AS (SELECT nc.tset, nc.label, ln(CAST(nc.n_c AS DOUBLE) / CAST(sum(nc.n_c) OVER (PARTITION BY nc.tset) AS DOUBLE)) AS log_prior,
               ln(coalesce(tot.total, 0.0) + vs.v_size) AS log_denom
        FROM nc JOIN vs USING (tset) LEFT JOIN tot USING (tset, label)),
tm AS (SELECT tset, label, term, ln(fc + 1.0) AS log_fc1 FROM fc),
intra_runs AS (SELECT 'intra' AS setting, dataset AS train_dataset, dataset AS test_dataset, seed, req_id,
                      dataset || ':' || CAST(seed AS VARCHAR) AS tset FROM split WHERE part = 'test'),
cross_runs AS (SELECT 'cross' AS setting, CASE WHEN dataset = '{DATASET_EVEN}' THEN '{DATASET_ODD}' ELSE '{DATASET_EVEN}' END AS train_dataset,
                      dataset AS test_dataset, s.seed, req_id,
                      (CASE WHEN dataset = '{DATASET_EVEN}' THEN '{DATASET_ODD}' ELSE '{DATASET_EVEN}' END) || ':all' AS tset
               FROM lab CROSS JOIN seeds s),
runs AS (SELECT r.*, v.variant FROM (SELECT * FROM intra_runs UNION ALL SELECT * FROM cross_runs) r
         CROSS JOIN (VALUES ('original'), ('masked_triggers'), ('removed_triggers')) v(variant)),
score_rows AS (SELECT DISTINCT tset, req_id, variant FROM runs),
tsw AS (SELECT s.tset, s.req_id, s.variant, x.term, (1.0 + ln(CAST(x.cnt AS DOUBLE))) * v.idf AS w
        FROM score_rows s JOIN terms_v x USING (req_id, variant) JOIN vocab v ON v.tset = s.tset AND v.term = x.term),
test_x AS (SELECT tset, req_id, variant, term, w / sqrt(sum(w * w) OVER (PARTITION BY tset, req_id, variant)) AS x FROM tsw),
sx AS (SELECT tset, req_id, variant, sum(x) AS sum_x FROM test_x GROUP BY ALL),
dot AS (SELECT x.tset, x.req_id, x.variant, m.label, sum(x.x * m.log_fc1) AS dot FROM test_x x JOIN tm m USING (tset, term) GROUP BY ALL),
scores AS (SELECT s.tset, s.req_id, s.variant, c.label,
                  c.log_prior + coalesce(d.dot, 0.0) - coalesce(sx.sum_x, 0.0) * c.log_denom AS score
           FROM score_rows s JOIN cls c USING (tset) LEFT JOIN sx USING (tset, req_id, variant)
           LEFT JOIN dot d USING (tset, req_id, variant, label)),
preds AS (SELECT tset, req_id, variant, CAST(label AS INTEGER) AS y_pred FROM (
            SELECT *, row_number() OVER (PARTITION BY tset, req_id, variant ORDER BY score DESC, label) AS rk FROM scores) t WHERE rk = 1),
nb_instances AS (SELECT r.setting, r.variant, r.train_dataset, r.test_dataset, 'MultinomialNB' AS model, CAST(r.seed AS INTEGER) AS seed,
                        r.req_id, q.requirement_text AS text, CAST(q.label AS INTEGER) AS y_true, p.y_pred, q.reasons
                 FROM runs r LEFT JOIN preds p USING (tset, req_id, variant) JOIN req q USING (req_id)),
nb_runs AS (SELECT {RUN_KEYS}, {confusion_sql()}, count(*) AS n FROM nb_instances GROUP BY {RUN_KEYS}),
nb_results AS (SELECT {RUN_KEYS}, {metrics_sql(digits=None)}, tn, fp, fn, tp, n AS n_test FROM nb_runs)"""
)
