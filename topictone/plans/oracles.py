"""DuckDB SQL oracles, one per registered query with an exact SQL form.

They are written independently of the Spark code, from the definitions in the
operator docstrings.  Numeric conventions shared with the Spark side:
probabilities carry 4 decimals, baselines are integer sums of 1e-4 units
divided in DOUBLE, model weights are integer micro-units, literals are DOUBLE.
DuckDB's RE2 has no class intersection, so the token pattern here is the
letters-and-digits run (the test tables contain no Han characters).
"""

from __future__ import annotations

# Written out here, from Python's documentation: the characters that str.strip()
# removes, and the texts that pandas' CSV reader takes as missing.
WHITE = (r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}\x{2001}\x{2002}\x{2003}\x{2004}\x{2005}"
         r"\x{2006}\x{2007}\x{2008}\x{2009}\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
STRIP_PATTERN = f"^[{WHITE}]+|[{WHITE}]+$"
NONBLANK = f"[^{WHITE}]"
PANDAS_NA = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
             "NULL", "NaN", "None", "n/a", "nan", "null"]
TOKEN_RE = r"[\p{L}\p{N}]+"


def _untidy(key: str, expr: str = "text") -> str:
    """The texts of the untidy inputs, by the remainder of their key."""
    return (f"CASE ({key}) % 8 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN ' ' || chr(12288) || chr(9) || chr(160) "
            f"WHEN 4 THEN chr(12288) || ' ' || {expr} || chr(8195) || chr(10) ELSE {expr} END")


UNTIDY = f"(SELECT conv_id, turn, role, {_untidy('conv_id * 7 + turn')} AS text FROM conversations)"
UNTIDY_DOCS = f"(SELECT doc_id, {_untidy('doc_id')} AS text FROM documents)"


def _toks(expr: str, limit: int | None = None) -> str:
    t = f"regexp_extract_all(lower(coalesce({expr}, '')), '{TOKEN_RE}')"
    return f"list_slice({t}, 1, {limit})" if limit else t


def _valid(expr: str) -> str:
    return f"({expr} IS NOT NULL AND regexp_matches({expr}, '{NONBLANK}'))"


def _three_way(expr: str, pos="positive", neg="negative", neu="neutral") -> str:
    return (f"CASE WHEN {expr} > 0.6::DOUBLE THEN '{pos}' "
            f"WHEN {expr} < 0.4::DOUBLE THEN '{neg}' ELSE '{neu}' END")


# -------------------------------------------------------------- events --

def _event_p(positive_leaning: bool) -> str:
    v = "CAST(round(value * 100) AS BIGINT)"
    p4 = f"(({v} * 10000) // ({v} + 5000))"
    if positive_leaning:
        p4 = f"(10000 - {p4})"
    return f"CAST({p4} AS DOUBLE) / 10000.0::DOUBLE"


def _events_ctes(positive_leaning: bool = False, topic: str = "user_id") -> str:
    """CTEs ``scored``, ``bl`` (baselines) and ``res`` (adjusted rows)."""
    grp = f"GROUP BY {topic}" if topic else ""
    sel_topic = f"{topic}, " if topic else ""
    join = f"JOIN bl ON s.{topic} IS NOT DISTINCT FROM bl.{topic}" if topic else "CROSS JOIN bl"
    return f"""
scored AS (
  SELECT event_id, user_id, event_type, value, {_event_p(positive_leaning)} AS pos_prob
  FROM events),
agg AS (
  SELECT {sel_topic}count(*) AS n,
         CAST(sum(CAST(round(pos_prob * 10000.0::DOUBLE) AS BIGINT)) AS BIGINT) AS sum_p4
  FROM scored {grp}),
bl AS (
  SELECT {sel_topic}n, sum_p4, CAST(sum_p4 AS DOUBLE) / (10000.0::DOUBLE * n) AS baseline
  FROM agg WHERE n > 0),
adj AS (
  SELECT s.*, bl.baseline AS topic_baseline,
         CASE WHEN bl.baseline > 0.6::DOUBLE AND s.pos_prob < 0.4::DOUBLE
                THEN 0.3::DOUBLE * (1.0::DOUBLE - s.pos_prob)
              WHEN bl.baseline < 0.4::DOUBLE AND s.pos_prob > 0.6::DOUBLE
                THEN 0.3::DOUBLE * s.pos_prob
              ELSE 0.0::DOUBLE END AS adj_factor
  FROM scored s {join}),
res AS (
  SELECT event_id, user_id, event_type, value,
         CASE WHEN pos_prob > 0.5::DOUBLE THEN 'positive' ELSE 'negative' END AS abs_sentiment,
         CASE WHEN pos_prob > 0.5::DOUBLE THEN pos_prob ELSE 1.0::DOUBLE - pos_prob END AS abs_confidence,
         {_three_way('q')} AS adj_sentiment,
         pos_prob, q AS adj_pos_prob, adj_factor, topic_baseline
  FROM (SELECT *,
               CASE WHEN topic_baseline > 0.6::DOUBLE THEN pos_prob + adj_factor
                    WHEN topic_baseline < 0.4::DOUBLE THEN pos_prob - adj_factor
                    ELSE pos_prob END AS q
        FROM adj) t)"""


def _events(body: str, positive_leaning: bool = False, topic: str = "user_id") -> str:
    return f"WITH {_events_ctes(positive_leaning, topic)}\n{body}"


def _report(src: str, topic: str) -> str:
    """Report columns over a result relation ``src`` grouped by ``topic``."""
    return f"""
rcnt AS (
  SELECT {topic}, count(*) AS n, max(topic_baseline) AS baseline,
         count(*) FILTER (WHERE abs_sentiment = 'positive') AS orig_pos,
         count(*) FILTER (WHERE abs_sentiment = 'negative') AS orig_neg,
         count(*) FILTER (WHERE adj_sentiment = 'positive') AS adj_pos,
         count(*) FILTER (WHERE adj_sentiment = 'negative') AS adj_neg,
         count(*) FILTER (WHERE adj_sentiment = 'neutral') AS adj_neutral
  FROM {src} GROUP BY {topic}),
rep AS (
  SELECT {topic}, n, baseline, {_three_way('baseline')} AS polarity,
         orig_pos, orig_neg, adj_pos, adj_neg, adj_neutral,
         orig_pos / n AS orig_pos_share, orig_neg / n AS orig_neg_share,
         adj_pos / n AS adj_pos_share, adj_neg / n AS adj_neg_share,
         adj_neutral / n AS adj_neutral_share,
         CAST(CASE WHEN baseline > 0.6::DOUBLE THEN adj_pos - orig_pos
              WHEN baseline < 0.4::DOUBLE THEN orig_pos - adj_pos END AS DOUBLE) AS effect,
         n < 50 AS low_support
  FROM rcnt)"""


# ----------------------------------------------------------- documents --

def _nb_ctes(label: str = "quality", where_split: str | None = None, min_count: int = 1) -> str:
    """CTEs ``lab`` (training rows), ``w`` (weights), ``pr`` (prior)."""
    having = f" HAVING count(*) >= {min_count}" if min_count > 1 else ""
    src = "labelled"
    if where_split:
        src = f"(SELECT * FROM split_rows WHERE split = '{where_split}')"
    return f"""
labelled AS (
  SELECT l.doc_id, d.text, l.{label} AS label
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
lab AS (SELECT * FROM {src} WHERE label IN (0, 1)),
ltok AS (SELECT label, unnest({_toks('text')}) AS token FROM lab),
cnt AS (
  SELECT token, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1
  FROM ltok GROUP BY token{having}),
tot AS (SELECT CAST(sum(n1) AS BIGINT) AS s1, CAST(sum(n0) AS BIGINT) AS s0, count(*) AS v FROM cnt),
w AS (
  SELECT token, n0, n1,
         CAST(round((ln(CAST(n1 + 1 AS DOUBLE) / CAST(s1 + v AS DOUBLE))
                   - ln(CAST(n0 + 1 AS DOUBLE) / CAST(s0 + v AS DOUBLE))) * 1000000.0::DOUBLE) AS BIGINT) AS k
  FROM cnt, tot),
pr AS (
  SELECT CAST(round(ln(CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE)
                     / CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE)) * 1000000.0::DOUBLE) AS BIGINT) AS prior
  FROM lab)"""


def _nb_doc_ctes(docs: str = "documents", key: str = "doc_id", normalise: str = "sum") -> str:
    """CTE ``nbs``: ``key, nb_z, n_tokens, pos_prob`` for every row of ``docs``."""
    if normalise == "sum":
        z = "pr.prior + coalesce(ks.ksum, 0)"
    else:
        z = ("CAST(pr.prior AS DOUBLE) + 4.0::DOUBLE * CAST(coalesce(ks.ksum, 0) AS DOUBLE)"
             " / CAST(greatest(coalesce(ks.ntok, 0), 1) AS DOUBLE)")
    return f"""
dtok AS (SELECT {key}, unnest({_toks('text')}) AS token FROM {docs}),
ks AS (
  SELECT dtok.{key}, CAST(sum(coalesce(w.k, 0)) AS BIGINT) AS ksum, count(*) AS ntok
  FROM dtok LEFT JOIN w ON dtok.token = w.token GROUP BY dtok.{key}),
zz AS (
  SELECT d.{key}, {z} AS nb_z, coalesce(ks.ntok, 0) AS n_tokens
  FROM {docs} d CROSS JOIN pr LEFT JOIN ks ON d.{key} = ks.{key}),
nbs AS (
  SELECT {key}, nb_z, n_tokens,
         round(1.0::DOUBLE / (1.0::DOUBLE + exp(-least(greatest(CAST(nb_z AS DOUBLE) / 1000000.0::DOUBLE, -30.0::DOUBLE), 30.0::DOUBLE))), 4) AS pos_prob
  FROM zz)"""


def _docs_topic_ctes(label: str, normalise: str, topics: list[str],
                     docs_cols: str = "doc_id, lang, source, n_chars, text",
                     docs: str = "documents", key: str = "doc_id") -> str:
    """CTE ``res``: topic analysis of ``docs`` scored by the NB model."""
    tcols = ", ".join(topics)
    on = " AND ".join(f"s.{t} IS NOT DISTINCT FROM bl.{t}" for t in topics)
    return f"""{_nb_ctes(label)},
src AS (SELECT {docs_cols} FROM {docs} WHERE {_valid('text')}),
{_nb_doc_ctes('src', key, normalise)},
scored AS (SELECT src.*, nbs.pos_prob FROM src JOIN nbs ON src.{key} = nbs.{key}),
agg AS (
  SELECT {tcols}, count(*) AS n,
         CAST(sum(CAST(round(pos_prob * 10000.0::DOUBLE) AS BIGINT)) AS BIGINT) AS sum_p4
  FROM scored GROUP BY {tcols}),
bl AS (SELECT {tcols}, n, sum_p4, CAST(sum_p4 AS DOUBLE) / (10000.0::DOUBLE * n) AS baseline FROM agg),
adj AS (
  SELECT s.*, bl.baseline AS topic_baseline,
         CASE WHEN bl.baseline > 0.6::DOUBLE AND s.pos_prob < 0.4::DOUBLE
                THEN 0.3::DOUBLE * (1.0::DOUBLE - s.pos_prob)
              WHEN bl.baseline < 0.4::DOUBLE AND s.pos_prob > 0.6::DOUBLE
                THEN 0.3::DOUBLE * s.pos_prob
              ELSE 0.0::DOUBLE END AS adj_factor
  FROM scored s JOIN bl ON {on}),
res AS (
  SELECT * EXCLUDE (q, pos_prob, adj_factor, topic_baseline),
         CASE WHEN pos_prob > 0.5::DOUBLE THEN 'positive' ELSE 'negative' END AS abs_sentiment,
         CASE WHEN pos_prob > 0.5::DOUBLE THEN pos_prob ELSE 1.0::DOUBLE - pos_prob END AS abs_confidence,
         {_three_way('q')} AS adj_sentiment,
         pos_prob, q AS adj_pos_prob, adj_factor, topic_baseline
  FROM (SELECT *,
               CASE WHEN topic_baseline > 0.6::DOUBLE THEN pos_prob + adj_factor
                    WHEN topic_baseline < 0.4::DOUBLE THEN pos_prob - adj_factor
                    ELSE pos_prob END AS q
        FROM adj) t)"""


SPLIT_BUCKET = "(('0x' || substr(md5('42:' || coalesce(CAST({k} AS VARCHAR), '')), 1, 8))::BIGINT % 10000)"


def _split(expr: str) -> str:
    b = SPLIT_BUCKET.format(k=expr)
    return f"CASE WHEN {b} < 7000 THEN 'train' WHEN {b} < 8500 THEN 'eval' ELSE 'test' END"


LABELLED_UNION = """
lu AS (
  SELECT d.text, l.quality AS label, 'labelled' AS origin
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
  UNION ALL SELECT text, 1, 'positive_lines' FROM benchmark
  UNION ALL SELECT text, 0, 'negative_lines' FROM conversations)"""

SPLIT_ASSIGN = f"""{LABELLED_UNION.replace('FROM conversations', f'FROM {UNTIDY}')},
sa AS (SELECT origin, label, {_split('text')} AS split, text FROM lu WHERE text IS NOT NULL)"""

VOCAB = f"""
vt AS (SELECT unnest({_toks('text')}) AS token FROM documents),
vc AS (SELECT token, count(*) AS n FROM vt GROUP BY token HAVING count(*) >= 2),
vocab AS (
  SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token ASC) + 1 AS INTEGER) AS id
  FROM vc ORDER BY n DESC, token ASC LIMIT 5000)"""


def _split_accuracy(split: str) -> str:
    return f"""WITH
split_rows AS (
  SELECT l.doc_id, d.text, l.quality AS label, {_split('d.text')} AS split
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL),
{_nb_ctes('quality', where_split='train')[1:]},
part AS (SELECT doc_id, text, label AS gold FROM split_rows WHERE split = '{split}'),
{_nb_doc_ctes('part', 'doc_id', 'sum')}
SELECT count(*) AS n,
       count(*) FILTER (WHERE CASE WHEN nbs.pos_prob > 0.5::DOUBLE THEN 1 ELSE 0 END = part.gold) AS correct,
       count(*) FILTER (WHERE CASE WHEN nbs.pos_prob > 0.5::DOUBLE THEN 1 ELSE 0 END = part.gold)
         / count(*) AS accuracy
FROM part JOIN nbs ON part.doc_id = nbs.doc_id"""


PREDICT_SELECT = """SELECT doc_id,
               CASE WHEN pos_prob > 0.5::DOUBLE THEN 1 ELSE 0 END AS label,
               CASE WHEN pos_prob > 0.5::DOUBLE THEN '好评 (Positive)' ELSE '差评 (Negative)' END AS sentiment,
               round(CASE WHEN pos_prob > 0.5::DOUBLE THEN pos_prob ELSE 1.0::DOUBLE - pos_prob END, 4) AS confidence"""

DOC_TOPICS = ["source", "lang"]

ORACLES: dict[str, str] = {
    "valid_comments": f"SELECT conv_id, turn, role, text FROM {UNTIDY} WHERE {_valid('text')}",
    "stripped_text": f"SELECT doc_id, regexp_replace(text, '{STRIP_PATTERN}', '', 'g') AS text_stripped FROM {UNTIDY_DOCS}",
    "null_to_empty": f"""SELECT l.doc_id, l.quality, coalesce(d.text, '') AS text
        FROM labels l LEFT JOIN {UNTIDY_DOCS} d ON l.doc_id = d.doc_id""",
    "labelled_union": f"WITH {LABELLED_UNION[1:]} SELECT text, label, origin FROM lu",
    "split_assign": f"WITH {SPLIT_ASSIGN[1:]} SELECT * FROM sa",
    "split_sizes": f"WITH {SPLIT_ASSIGN[1:]} SELECT split, count(*) AS n FROM sa GROUP BY split",
    "split_label_distribution": f"WITH {SPLIT_ASSIGN[1:]} SELECT split, label, count(*) AS n FROM sa GROUP BY split, label",
    "tokens_truncated": f"""SELECT doc_id, CAST(len({_toks('text')}) AS INTEGER) AS n_tokens_all,
        CAST(len({_toks('text', 128)}) AS INTEGER) AS n_tokens,
        array_to_string({_toks('text', 128)}, ' ') AS tokens FROM documents""",
    "vocabulary": f"WITH {VOCAB[1:]} SELECT token, n, id FROM vocab",
    "encoded_fixed_length": f"""WITH {VOCAB[1:]},
        toks AS (SELECT doc_id, {_toks('text', 128)} AS t FROM documents),
        ex AS (SELECT doc_id, unnest(t) AS token, unnest(generate_series(1, len(t))) AS pos FROM toks),
        ids AS (SELECT ex.doc_id, list(coalesce(v.id, 1) ORDER BY ex.pos) AS ids
                FROM ex LEFT JOIN vocab v ON ex.token = v.token GROUP BY ex.doc_id)
        SELECT toks.doc_id,
               array_to_string(list_resize(coalesce(ids.ids, []::INTEGER[]), 128, 0), ' ') AS input_ids,
               array_to_string(list_resize(list_transform(coalesce(ids.ids, []::INTEGER[]), lambda x: 1), 128, 0), ' ') AS attention_mask,
               CAST(len(coalesce(ids.ids, []::INTEGER[])) AS INTEGER) AS n_real
        FROM toks LEFT JOIN ids ON toks.doc_id = ids.doc_id""",
    "nb_model": f"WITH {_nb_ctes()[1:]} SELECT w.token, w.n0, w.n1, w.k, pr.prior FROM w CROSS JOIN pr",
    "nb_score": f"WITH {_nb_ctes()[1:]},{_nb_doc_ctes()} SELECT doc_id, nb_z, n_tokens, pos_prob FROM nbs",
    "nb_score_mean": f"WITH {_nb_ctes()[1:]},{_nb_doc_ctes(normalise='mean')} SELECT doc_id, nb_z, n_tokens, pos_prob FROM nbs",
    "predict_label_confidence": f"""WITH {_nb_ctes()[1:]},{_nb_doc_ctes()}
        {PREDICT_SELECT} FROM nbs""",
    "binary_reply": f"""WITH {_docs_topic_ctes('toxic', 'mean', ['source'])[1:]}
        SELECT doc_id, adj_sentiment,
               CASE WHEN adj_sentiment = 'positive' THEN 'positive' ELSE 'negative' END AS reply FROM res""",
    "accuracy": _split_accuracy("train"),
    "test_accuracy": _split_accuracy("test"),
    "topic_baseline": _events("SELECT user_id, n, sum_p4, baseline FROM bl"),
    "topic_polarity": _events(f"SELECT user_id, baseline, {_three_way('baseline')} AS polarity FROM bl"),
    "topic_support_flag": _events("SELECT user_id, n, n < 50 AS low_support FROM bl"),
    "adjustment": _events("SELECT event_id, user_id, pos_prob, topic_baseline, adj_factor, adj_pos_prob FROM res"),
    "adjusted_class": _events("SELECT event_id, adj_pos_prob, adj_sentiment FROM res"),
    "absolute_class": _events("SELECT event_id, pos_prob, abs_sentiment, abs_confidence FROM res"),
    "topic_analysis_events_neg": _events("SELECT * FROM res"),
    "topic_analysis_events_pos": _events("SELECT * FROM res", positive_leaning=True),
    "topic_analysis_documents": f"WITH {_docs_topic_ctes('quality', 'mean', DOC_TOPICS)[1:]} SELECT * EXCLUDE (text) FROM res",
    "topic_analysis_documents_toxic": f"WITH {_docs_topic_ctes('toxic', 'mean', DOC_TOPICS)[1:]} SELECT * EXCLUDE (text) FROM res",
    "topic_analysis_keep_invalid": f"""WITH {_docs_topic_ctes('quality', 'mean', ['role'],
        docs_cols='conv_id, turn, role, text, conv_id * 1000000 + turn AS turn_key',
        docs=f'(SELECT * FROM {UNTIDY})', key='turn_key')[1:]}
        SELECT * EXCLUDE (text, turn_key) FROM res UNION ALL BY NAME
        SELECT conv_id, turn, role FROM {UNTIDY} WHERE NOT coalesce({_valid('text')}, false)""",
    "topic_analysis_null_prob": _events("""SELECT * FROM res UNION ALL BY NAME
        SELECT e.event_id, e.user_id, e.event_type, e.value, bl.baseline AS topic_baseline
        FROM events e LEFT JOIN bl ON e.user_id IS NOT DISTINCT FROM bl.user_id WHERE e.event_id % 7 = 0""").replace(
        "FROM events),", "FROM events WHERE event_id % 7 <> 0),", 1),
    "topic_analysis_conversations": f"""WITH {_docs_topic_ctes('quality', 'mean', ['conv_id'],
        docs_cols='conv_id, turn, role, text, conv_id * 1000000 + turn AS turn_key',
        docs='conversations', key='turn_key')[1:]} SELECT * EXCLUDE (text, turn_key) FROM res""",
    "positive_rows": _events("SELECT * FROM res WHERE adj_sentiment = 'positive'"),
    "negative_rows": _events("SELECT * FROM res WHERE adj_sentiment = 'negative'", positive_leaning=True),
    "neutral_rows": _events("SELECT * FROM res WHERE adj_sentiment = 'neutral'"),
}


def _with_report(body: str, positive_leaning: bool = False) -> str:
    return (f"WITH {_events_ctes(positive_leaning)},{_report('res', 'user_id')}\n{body}")


ORACLES["class_counts"] = _with_report(
    "SELECT user_id, n, baseline, orig_pos, orig_neg, adj_pos, adj_neg, adj_neutral FROM rcnt")
ORACLES["class_shares"] = _with_report(
    "SELECT user_id, n, orig_pos_share, orig_neg_share, adj_pos_share, adj_neg_share, adj_neutral_share FROM rep")
ORACLES["adjustment_effect"] = _with_report(
    "SELECT user_id, polarity, orig_pos, adj_pos, effect FROM rep", positive_leaning=True)
ORACLES["transition_matrix"] = _events(
    "SELECT user_id, abs_sentiment, adj_sentiment, count(*) AS n FROM res GROUP BY ALL")
ORACLES["topic_report"] = (
    f"WITH {_docs_topic_ctes('quality', 'mean', DOC_TOPICS)[1:]},"
    f"{_report('res', 'source, lang')}\nSELECT * FROM rep")
ORACLES["topic_report_events"] = _with_report("SELECT * FROM rep")
ORACLES["global_topic"] = _events("SELECT * FROM res", topic="")
# A saved and reloaded model scores exactly as the fitted one.
ORACLES["nb_model_roundtrip"] = ORACLES["nb_score"]
# The shuffle joins give what the broadcast joins give.
ORACLES["nb_score_salted"] = ORACLES["nb_score"]
ORACLES["topic_analysis_events_salted"] = _events("SELECT * FROM res", topic="event_type")

# ------------------------------------------------------------- file I/O --

NA_LIST = ", ".join("'" + v + "'" for v in PANDAS_NA)
CSV_DOCS = f"(SELECT * FROM documents WHERE text NOT IN ({NA_LIST}))"
LINE_SPLIT = r"'\r\n|\r|\n'"

ORACLES["csv_comments"] = (
    f'SELECT doc_id, source, text AS "评论" FROM {CSV_DOCS} d WHERE {_valid("text")}')
ORACLES["csv_comments_split"] = """SELECT doc_id, source, lang, md5(coalesce(text, '')) AS text_md5,
       CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
       CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS BIGINT) AS n_lines FROM documents"""
ORACLES["csv_topic_job"] = (
    f"WITH {_docs_topic_ctes('quality', 'mean', ['source'], docs=CSV_DOCS)[1:]},"
    f"{_report('res', 'source')}\nSELECT * FROM rep")
ORACLES["csv_class_split"] = (
    f"WITH {_docs_topic_ctes('quality', 'mean', ['source'], docs=CSV_DOCS)[1:]}\n"
    "SELECT adj_sentiment AS adj_class, count(*) AS n FROM res GROUP BY 1")
def _untidy_lines(table: str) -> str:
    """The stripped lines of the untidy line files: a line that begins with a is
    blank, one that begins with t is padded."""
    return f"""SELECT CASE WHEN lower(substr(t, 1, 1)) = 'a' THEN '' ELSE regexp_replace(t, '{STRIP_PATTERN}', '', 'g') END AS text
    FROM (SELECT unnest(regexp_split_to_array(text, {LINE_SPLIT})) AS t FROM {table} WHERE text IS NOT NULL)"""


ORACLES["text_lines"] = f"SELECT text FROM ({_untidy_lines('documents')}) WHERE text <> ''"
ORACLES["labelled_lines"] = f"SELECT text, 1 AS label FROM ({_untidy_lines('benchmark')})"

ORACLES["encoded_training_set"] = f"""WITH {VOCAB[1:]},
    toks AS (SELECT l.doc_id, l.quality AS label, {_toks('d.text', 128)} AS t
             FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
    ex AS (SELECT doc_id, unnest(t) AS token, unnest(generate_series(1, len(t))) AS pos FROM toks),
    ids AS (SELECT ex.doc_id, list(coalesce(v.id, 1) ORDER BY ex.pos) AS ids
            FROM ex LEFT JOIN vocab v ON ex.token = v.token GROUP BY ex.doc_id)
    SELECT toks.doc_id, toks.label,
           array_to_string(list_resize(coalesce(ids.ids, []::INTEGER[]), 128, 0), ' ') AS input_ids,
           array_to_string(list_resize(list_transform(coalesce(ids.ids, []::INTEGER[]), lambda x: 1), 128, 0), ' ') AS attention_mask
    FROM toks LEFT JOIN ids ON toks.doc_id = ids.doc_id"""

ORACLES["labelled_csv"] = """SELECT d.text, l.quality AS label
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
ORACLES["prediction_log"] = f"""WITH {_nb_ctes()[1:]},{_nb_doc_ctes()},
    one AS ({PREDICT_SELECT}, 'documents' AS source_name FROM nbs)
    SELECT * FROM one UNION ALL SELECT * FROM one"""

ORACLES["nb_score_min_count"] = (
    f"WITH {_nb_ctes(min_count=2)[1:]},{_nb_doc_ctes()} SELECT doc_id, nb_z, n_tokens, pos_prob FROM nbs")

# Training flow: keyed split of the labelled union, NB on train, the variant
# with the better eval accuracy (ties: "sum"), accuracy per split.
_SIG = ("round(1.0::DOUBLE / (1.0::DOUBLE + exp(-least(greatest(CAST({z} AS DOUBLE) / "
        "1000000.0::DOUBLE, -30.0::DOUBLE), 30.0::DOUBLE))), 4)")
ORACLES["training_metrics"] = f"""WITH {LABELLED_UNION[1:]},
split_rows AS (
  SELECT row_number() OVER () AS doc_id, text, label, {_split('text')} AS split
  FROM lu WHERE text IS NOT NULL),
{_nb_ctes('quality', where_split='train')[1:]},
dtok AS (SELECT doc_id, unnest({_toks('text')}) AS token FROM split_rows),
ks AS (
  SELECT dtok.doc_id, CAST(sum(coalesce(w.k, 0)) AS BIGINT) AS ksum, count(*) AS ntok
  FROM dtok LEFT JOIN w ON dtok.token = w.token GROUP BY dtok.doc_id),
zz AS (
  SELECT d.split, d.label, pr.prior + coalesce(ks.ksum, 0) AS z_sum,
         CAST(pr.prior AS DOUBLE) + 4.0::DOUBLE * CAST(coalesce(ks.ksum, 0) AS DOUBLE)
           / CAST(greatest(coalesce(ks.ntok, 0), 1) AS DOUBLE) AS z_mean
  FROM split_rows d CROSS JOIN pr LEFT JOIN ks ON d.doc_id = ks.doc_id),
pp AS (
  SELECT split, label,
         CASE WHEN {_SIG.format(z='z_sum')} > 0.5::DOUBLE THEN 1 ELSE 0 END AS pred_sum,
         CASE WHEN {_SIG.format(z='z_mean')} > 0.5::DOUBLE THEN 1 ELSE 0 END AS pred_mean
  FROM zz),
ev AS (
  SELECT count(*) FILTER (WHERE pred_sum = label) / count(*) AS acc_sum,
         count(*) FILTER (WHERE pred_mean = label) / count(*) AS acc_mean
  FROM pp WHERE split = 'eval'),
choice AS (SELECT CASE WHEN acc_mean > acc_sum THEN 'mean' ELSE 'sum' END AS variant FROM ev),
hits AS (
  SELECT pp.split, choice.variant,
         CASE WHEN choice.variant = 'sum' THEN pred_sum ELSE pred_mean END = pp.label AS hit
  FROM pp CROSS JOIN choice)
SELECT split, count(*) AS n, count(*) FILTER (WHERE hit) AS correct,
       count(*) FILTER (WHERE hit) / count(*) AS accuracy, variant
FROM hits GROUP BY split, variant"""

# ---------------------------------------------------------- hashed model --
# The fitted weights have no SQL form; what must follow from them has.
ORACLES["hashed_score"] = """SELECT doc_id, source, lang, true AS p_in_range, true AS label_follows, true AS confidence_follows
    FROM documents"""
ORACLES["hashed_best_model"] = f"""SELECT reg_param, eval_n, true AS accuracy_follows, true AS chosen_is_best
    FROM (SELECT count(*) AS eval_n FROM labels l JOIN documents d ON l.doc_id = d.doc_id
          WHERE d.text IS NOT NULL AND l.quality IN (0, 1) AND {_split('d.text')} = 'eval')
    CROSS JOIN (SELECT unnest([0.0, 0.01, 0.1])::DOUBLE AS reg_param)"""
ORACLES["hashed_topic_analysis"] = f"""SELECT doc_id, source, lang, true AS p_in_range, true AS baseline_follows,
    true AS adjustment_follows, true AS class_follows FROM documents WHERE {_valid('text')}"""
ORACLES["hashed_model_roundtrip"] = "SELECT doc_id, true AS same_score FROM documents"
_SPLIT_ROWS = f"""split_rows AS (SELECT l.doc_id, d.text, l.quality AS label, {_split('d.text')} AS split
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL)"""
ORACLES["hashed_features"] = f"""WITH {_SPLIT_ROWS},
t AS (SELECT DISTINCT doc_id, unnest({_toks('text')}) AS token FROM split_rows WHERE split = 'train')
SELECT token, count(*) AS df, true AS bucket_ok FROM t GROUP BY token"""
ORACLES["hashed_score_recomputed"] = "SELECT doc_id, true AS score_follows FROM documents"
ORACLES["hashed_training"] = f"""WITH {_SPLIT_ROWS}
SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positive, true AS follows FROM split_rows GROUP BY split"""
ORACLES["sample_predictions"] = f"""WITH {_nb_ctes()[1:]}, samples AS (SELECT item_id AS doc_id, text FROM benchmark),
    {_nb_doc_ctes('samples')} {PREDICT_SELECT} FROM nbs"""

# ------------------------------------------------------- written results --
_WRITTEN = _docs_topic_ctes("quality", "mean", ["source"], docs=CSV_DOCS)[1:]
_AS_TEXT = """doc_id, text AS "评论", abs_sentiment, adj_sentiment, pos_prob, topic_baseline"""
ORACLES["csv_result_rows"] = f"WITH {_WRITTEN}\nSELECT {_AS_TEXT} FROM res"
ORACLES["csv_class_rows"] = f"WITH {_WRITTEN}\nSELECT adj_sentiment AS adj_class, {_AS_TEXT} FROM res"

# D2 with exact sizes: held back ceil(0.3 n), of those ceil(half) for test.
SPLIT_EXACT = f"""{LABELLED_UNION.replace('FROM conversations', f'FROM {UNTIDY}')},
ranked AS (
  SELECT *, count(*) OVER () AS n,
         row_number() OVER (ORDER BY md5('42:' || coalesce(text, '')) || md5(concat_ws(':', text IS NULL, label, origin))) AS place
  FROM lu),
sa AS (
  SELECT origin, label, text,
         CASE WHEN place <= n - (3 * n + 9) // 10 THEN 'train'
              WHEN place <= n - ((3 * n + 9) // 10 + 1) // 2 THEN 'eval' ELSE 'test' END AS split
  FROM ranked)"""

ORACLES["split_exact"] = f"WITH {SPLIT_EXACT[1:]} SELECT * FROM sa WHERE text IS NOT NULL"
ORACLES["split_exact_sizes"] = f"WITH {SPLIT_EXACT[1:]} SELECT split, count(*) AS n FROM sa GROUP BY split"

# Three classes: multinomial naive Bayes, softmax with the largest logit taken out.
_THREE = ["good", "poor", "toxic"]


def _each(form: str, sep: str = ", ") -> str:
    return sep.join(form.format(c=c) for c in _THREE)


CLASS_MODEL = f"""
cl AS (
  SELECT d.text, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'poor' END AS name
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
cc AS (
  SELECT token, {_each("count(*) FILTER (WHERE name = '{c}') AS n_{c}")}
  FROM (SELECT name, unnest({_toks('text')}) AS token FROM cl WHERE name IS NOT NULL) GROUP BY token),
ct AS (SELECT count(*) AS v, {_each('CAST(sum(n_{c}) AS BIGINT) AS s_{c}')} FROM cc),
cw AS (
  SELECT token, {_each('n_{c}')},
         {_each('CAST(round(ln(CAST(n_{c} + 1 AS DOUBLE) / CAST(s_{c} + v AS DOUBLE)) * 1000000.0::DOUBLE) AS BIGINT) AS k_{c}')}
  FROM cc, ct)"""

CLASS_SCORE = f"""{CLASS_MODEL},
cp AS (
  SELECT {_each("CAST(round(ln(CAST(count(*) FILTER (WHERE name = '{c}') AS DOUBLE) / CAST(count(name) AS DOUBLE)) * 1000000.0::DOUBLE) AS BIGINT) AS p_{c}")}
  FROM cl),
cs AS (
  SELECT t.doc_id, {_each('CAST(sum(k_{c}) AS BIGINT) AS s_{c}')}
  FROM (SELECT doc_id, unnest({_toks('text')}) AS token FROM documents) t JOIN cw ON t.token = cw.token GROUP BY t.doc_id),
cz AS (
  SELECT d.doc_id, {_each('coalesce(s_{c}, 0) + p_{c} AS z_{c}')}
  FROM documents d CROSS JOIN cp LEFT JOIN cs ON d.doc_id = cs.doc_id),
ce AS (
  SELECT *, {_each('exp(CAST(z_{c} AS DOUBLE) / 1000000.0::DOUBLE - CAST(greatest(z_good, z_poor, z_toxic) AS DOUBLE) / 1000000.0::DOUBLE) AS e_{c}')}
  FROM cz)"""

ORACLES["class_model"] = f"WITH {CLASS_MODEL[1:]} SELECT * FROM cw"
ORACLES["class_score"] = ORACLES["class_score_salted"] = f"""WITH {CLASS_SCORE[1:]}
SELECT doc_id,
       CASE WHEN z_good >= z_poor AND z_good >= z_toxic THEN 'good' WHEN z_poor >= z_toxic THEN 'poor' ELSE 'toxic' END AS class,
       round(1.0::DOUBLE / (e_good + e_poor + e_toxic), 4) AS confidence,
       {_each('round(e_{c} / (e_good + e_poor + e_toxic), 4) AS p_{c}')}
FROM ce"""
