"""DuckDB SQL oracles: the same results written independently from the
formulas, over the driver's views. Shared CTEs are built by the helpers below
and prefixed to each oracle."""

from __future__ import annotations

from .functions import constants as K

# the oracles' own patterns (not those of the code under test)
TOKEN_RE = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
TOKEN_OR_GAP_RE = TOKEN_RE + r"|[^\p{L}\p{M}\p{N}_]+"
SENTENCE_RE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sentences(body: str) -> str:
    """Sentences of a text: dots between word characters (found by two plain
    replaces, as one may begin where another ends) are hidden from the split."""
    once = r"regexp_replace({}, '([\p{{L}}\p{{M}}\p{{N}}_])\.([\p{{L}}\p{{M}}\p{{N}}_])', '\1' || chr(57344) || '\2', 'g')"
    masked = once.format(once.format(body))
    return f"[replace(x, chr(57344), '.') FOR x IN regexp_extract_all({masked}, {q(SENTENCE_RE)})]"


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


STOPS = sql_list(list(K.DEFAULT_STOP_WORDS) + list(K.STOP_CHARS))

EVIDENCE = """ev AS (
  SELECT CAST(doc_id * 2 AS VARCHAR) AS ID,
         CONCAT('doc', CAST(doc_id AS VARCHAR),
                CASE doc_id % 8 WHEN 0 THEN '.txt' WHEN 1 THEN '.html' WHEN 2 THEN '.pdf' WHEN 3 THEN '.xls'
                                WHEN 4 THEN '.sqlite' WHEN 5 THEN '.lnk' WHEN 6 THEN '.exe' ELSE '' END) AS name,
         CASE WHEN doc_id % 5 = 4 THEN '$Unallocated/'
              WHEN doc_id % 3 = 0 THEN 'WINDOWS/system32/'
              WHEN doc_id % 3 = 1 THEN 'home/from/'
              ELSE 'Users/notes/' END AS path,
         CASE doc_id % 8 WHEN 0 THEN 'txt' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' WHEN 3 THEN 'xls'
                         WHEN 4 THEN 'sqlite' WHEN 5 THEN 'lnk' WHEN 6 THEN 'exe' ELSE '' END AS extension,
         n_chars AS size,
         1300000000 + doc_id * 3600 AS created,
         1300086400 + doc_id * 3600 AS modified,
         1300172800 + doc_id * 3600 AS accessed,
         text AS body,
         CAST(LENGTH(text) AS BIGINT) AS body_len,
         doc_id % 5 = 4 AS is_unallocated
  FROM documents)"""

TOKENS = f"""stops AS (SELECT DISTINCT lower(unnest({STOPS})) AS term),
raw_tok AS (
  SELECT ID, unnest(a) AS term, generate_subscripts(a, 1) - 1 AS pos
  FROM (SELECT ID, regexp_extract_all(lower(body), {q(TOKEN_RE)}) AS a FROM ev)),
tok AS (SELECT ID, term, pos FROM raw_tok WHERE term NOT IN (SELECT term FROM stops))"""

DOC_TERMS = """dt AS (SELECT ID, term, COUNT(*) AS tf FROM tok GROUP BY ID, term),
ds AS (SELECT ID, SUM(tf) AS len, SUM(tf * tf) AS sum_tf2, COUNT(*) AS n_terms FROM dt GROUP BY ID),
ts AS (SELECT term, COUNT(*) AS df, SUM(tf) AS ttf FROM dt GROUP BY term),
nd AS (SELECT COUNT(*) AS n FROM ev)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def base(body: str) -> str:
    """Evidence + tokens + term vectors + statistics, then ``body``."""
    return with_ctes(EVIDENCE, TOKENS, DOC_TERMS, body=body)


def or_query_scores(terms: list[str]) -> str:
    """CTE ``sc(ID, score)``: classic TF-IDF for an OR of terms."""
    return f"""qt AS (SELECT unnest({sql_list(terms)}) AS term),
qi AS (SELECT qt.term, 1 + ln(nd.n / (COALESCE(ts.df, 0) + 1.0)) AS idf
       FROM qt CROSS JOIN nd LEFT JOIN ts ON ts.term = qt.term),
qn AS (SELECT 1 / sqrt(SUM(idf * idf)) AS qnorm, COUNT(*) AS nq FROM qi),
sc AS (SELECT dt.ID, SUM(sqrt(dt.tf) * qi.idf * qi.idf) / sqrt(MAX(ds.len))
              * (COUNT(*) * 1.0 / MAX(qn.nq)) * MAX(qn.qnorm) AS score
       FROM dt JOIN qi ON dt.term = qi.term JOIN ds ON ds.ID = dt.ID CROSS JOIN qn
       GROUP BY dt.ID)"""


FLAGSHIP = ["from", "tion", "des"]
PHRASE = ["anea", "eriner"]

ORACLE_SQL: dict[str, str] = {}
_LATER = {}  # built at the end of the module, when all parts are defined


def oracle(name):
    def deco(fn):
        _LATER[name] = fn
        return fn
    return deco


@oracle("e1_tfidf_or")
def _e1():
    return with_ctes(EVIDENCE, TOKENS, DOC_TERMS, or_query_scores(FLAGSHIP),
                     body="SELECT ID, round(score, 6) AS score FROM sc")


@oracle("e3_top20")
def _e3():
    return with_ctes(EVIDENCE, TOKENS, DOC_TERMS, or_query_scores(FLAGSHIP),
                     body="SELECT ID, round(score, 6) AS score FROM sc "
                          "ORDER BY round(score, 6) DESC, CAST(ID AS BIGINT) LIMIT 20")


# ------------------------------------------------------------ C: analysis

@oracle("c1_tokens")
def _c1():
    return with_ctes(EVIDENCE, TOKENS, body="SELECT ID, CAST(pos AS INTEGER) AS pos, term FROM raw_tok")


@oracle("c1_mixed_scripts")
def _c1_mixed():
    """Scripts without spaces are set apart before words are taken."""
    apart = "regexp_replace({}, '({})', ' \\1 ', 'g')"
    text = "lower(translate(body, 'aeohtd', '書ばアーกこ'))"
    for script in ("[\\p{Han}\\p{Hiragana}]", "[\\p{Katakana}ー]+", "\\p{Thai}+"):
        text = apart.format(text, script)
    return with_ctes(EVIDENCE, body=f"""SELECT ID, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS term
FROM (SELECT ID, regexp_extract_all({text}, {q(TOKEN_RE)}) AS a FROM ev)""")


@oracle("c2_stop_removal")
def _c2():
    return with_ctes(EVIDENCE, TOKENS, body="SELECT ID, CAST(pos AS INTEGER) AS pos, term FROM tok")


PIECES = f"""pieces AS (
  SELECT ID, unnest(a) AS piece, generate_subscripts(a, 1) AS k
  FROM (SELECT ID, regexp_extract_all(body, {q(TOKEN_OR_GAP_RE)}) AS a FROM ev)),
loc AS (
  SELECT ID, piece, regexp_matches(piece, {q('^[\\p{L}\\p{M}\\p{N}_]')}) AS is_tok,
         SUM(length(piece)) OVER (PARTITION BY ID ORDER BY k ROWS UNBOUNDED PRECEDING) AS e,
         SUM(CASE WHEN regexp_matches(piece, {q('^[\\p{L}\\p{M}\\p{N}_]')}) THEN 1 ELSE 0 END)
           OVER (PARTITION BY ID ORDER BY k ROWS UNBOUNDED PRECEDING) AS ntok
  FROM pieces)"""


@oracle("c3_postings_offsets")
def _c3():
    return with_ctes(EVIDENCE, TOKENS, PIECES, body="""
SELECT ID, lower(piece) AS term, CAST(ntok - 1 AS INTEGER) AS pos,
       CAST(e - length(piece) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end"
FROM loc WHERE is_tok AND lower(piece) NOT IN (SELECT term FROM stops)""")


@oracle("c4_doc_terms")
def _c4():
    return base("SELECT ID, term, tf FROM dt")


@oracle("c5_doc_freq")
def _c5():
    return base("SELECT term, df FROM ts")


@oracle("c6_total_term_freq")
def _c6():
    return base("SELECT term, CAST(ttf AS BIGINT) AS ttf FROM ts")


@oracle("c7_corpus_tokens")
def _c7():
    return base("SELECT CAST(SUM(ttf) AS BIGINT) AS num_tokens FROM ts")


@oracle("c8_docs_and_terms")
def _c8():
    return base("SELECT (SELECT n FROM nd) AS num_docs, (SELECT COUNT(*) FROM ts) AS num_terms")


@oracle("c9_field_length")
def _c9():
    return base("SELECT ID, CAST(len AS BIGINT) AS length FROM ds")


# ------------------------------------------------------------ D: clauses

def idf_cte(name: str, term: str) -> str:
    return (f"{name} AS (SELECT 1 + ln(nd.n / (COALESCE((SELECT df FROM ts WHERE term = {q(term)}), 0) + 1.0))"
            f" AS idf FROM nd)")


@oracle("d1_match_all")
def _d1():
    return with_ctes(EVIDENCE, body="SELECT ID, CAST(1.0 AS DOUBLE) AS score FROM ev")


@oracle("d2_term")
def _d2():
    return base(f""",{idf_cte('i1', 'from')}
SELECT dt.ID, round(sqrt(tf) * i1.idf / sqrt(ds.len), 6) AS score
FROM dt JOIN ds USING (ID) CROSS JOIN i1 WHERE dt.term = 'from'""")


@oracle("d3_field_exact")
def _d3():
    return with_ctes(EVIDENCE, body="""
, f AS (SELECT 1 + ln((SELECT COUNT(*) FROM ev) / ((SELECT COUNT(*) FROM ev WHERE extension = 'pdf') + 1.0)) AS idf)
SELECT ID, round(f.idf, 6) AS score FROM ev CROSS JOIN f WHERE extension = 'pdf'""".lstrip("\n")).replace(
        "\n, f AS", ",\nf AS")


@oracle("d4_or")
def _d4():
    return with_ctes(EVIDENCE, TOKENS, DOC_TERMS, or_query_scores(FLAGSHIP),
                     body="SELECT ID, round(score, 6) AS score FROM sc")


@oracle("d5_and")
def _d5():
    return base(f""",{idf_cte('i1', 'from')}, {idf_cte('i2', 'tion')},
qn AS (SELECT 1 / sqrt(i1.idf * i1.idf + i2.idf * i2.idf) AS qnorm FROM i1, i2)
SELECT a.ID, round((sqrt(a.tf) * i1.idf * i1.idf + sqrt(b.tf) * i2.idf * i2.idf) / sqrt(ds.len) * qn.qnorm, 6) AS score
FROM dt a JOIN dt b ON a.ID = b.ID AND a.term = 'from' AND b.term = 'tion'
JOIN ds ON ds.ID = a.ID CROSS JOIN i1 CROSS JOIN i2 CROSS JOIN qn""")


@oracle("d6_not")
def _d6():
    return base(f""",{idf_cte('i1', 'from')}
SELECT dt.ID, round(sqrt(tf) * i1.idf / sqrt(ds.len), 6) AS score
FROM dt JOIN ds USING (ID) CROSS JOIN i1
WHERE dt.term = 'from' AND dt.ID NOT IN (SELECT ID FROM dt WHERE term = 'des')""")


@oracle("d7_nested")
def _d7():
    return base("""
SELECT DISTINCT ID FROM dt WHERE term IN ('from', 'des')
  AND ID NOT IN (SELECT ID FROM dt WHERE term = 'tion')""")


@oracle("d8_phrase")
def _d8():
    return base("""
SELECT a.ID, COUNT(*) AS freq FROM tok a JOIN tok b ON a.ID = b.ID AND b.pos = a.pos + 1
WHERE a.term = 'anea' AND b.term = 'eriner' GROUP BY a.ID""")


@oracle("d9_proximity")
def _d9():
    return base("""
, occ AS (
  SELECT a.ID, a.pos, MIN(abs((b.pos - 1) - a.pos)) AS span
  FROM tok a JOIN tok b ON a.ID = b.ID AND abs((b.pos - 1) - a.pos) <= 2
  WHERE a.term = 'anea' AND b.term = 'eriner' GROUP BY a.ID, a.pos)
SELECT ID, round(SUM(1.0 / (span + 1)), 6) AS freq FROM occ GROUP BY ID""".replace("\n, occ", ",\nocc", 1))


@oracle("d10_prefix")
def _d10():
    return base("SELECT DISTINCT ID FROM dt WHERE starts_with(term, 'tion')")


@oracle("d11_wildcard")
def _d11():
    return base("SELECT DISTINCT ID FROM dt WHERE term LIKE 'an_a%'")


@oracle("d12_fuzzy")
def _d12():
    return base("SELECT DISTINCT ID FROM dt WHERE levenshtein(term, 'eriner') <= 1")


@oracle("d13_regexp")
def _d13():
    return base("SELECT DISTINCT ID FROM dt WHERE regexp_full_match(term, 't[io]+n[a-z]*')")


@oracle("d11_leading_wildcard")
def _d11_leading():
    return base("SELECT DISTINCT ID FROM dt WHERE term LIKE '%a_edble'")


@oracle("d12_fuzzy_two_edits")
def _d12_two():
    return base("SELECT DISTINCT ID FROM dt WHERE levenshtein(term, 'thatere') <= 2")


@oracle("d13_inner_literals")
def _d13_inner():
    return base("SELECT DISTINCT ID FROM dt WHERE regexp_full_match(term, '[a-z]+(?:ed)ble(er|an)?')")


@oracle("d14_range")
def _d14():
    return with_ctes(EVIDENCE, body="SELECT ID FROM ev WHERE size >= 1000 AND size < 5000")


@oracle("d15_boost")
def _d15():
    return base(f""",{idf_cte('i1', 'from')}, {idf_cte('i2', 'des')},
qn AS (SELECT 1 / sqrt(4 * i1.idf * i1.idf + i2.idf * i2.idf) AS qnorm FROM i1, i2),
parts AS (
  SELECT dt.ID, CASE dt.term WHEN 'from' THEN sqrt(tf) * i1.idf * i1.idf * 2
                             ELSE sqrt(tf) * i2.idf * i2.idf END AS s
  FROM dt CROSS JOIN i1 CROSS JOIN i2 WHERE dt.term IN ('from', 'des'))
SELECT parts.ID, round(SUM(s) / sqrt(MAX(ds.len)) * MAX(qn.qnorm) * COUNT(*) / 2.0, 6) AS score
FROM parts JOIN ds USING (ID) CROSS JOIN qn GROUP BY parts.ID""")


def _or2(extra: str = "") -> str:
    """Scores of ``from OR des``."""
    return base(f""",{idf_cte('i1', 'from')}, {idf_cte('i2', 'des')},
qn AS (SELECT 1 / sqrt(i1.idf * i1.idf + i2.idf * i2.idf) AS qnorm FROM i1, i2),
parts AS (SELECT dt.ID, sqrt(tf) * CASE dt.term WHEN 'from' THEN i1.idf * i1.idf ELSE i2.idf * i2.idf END AS s
          FROM dt CROSS JOIN i1 CROSS JOIN i2 WHERE dt.term IN ('from', 'des'))
SELECT parts.ID, round(SUM(s) / sqrt(MAX(ds.len)) * MAX(qn.qnorm) * COUNT(*) / 2.0, 6) AS score
FROM parts JOIN ds USING (ID) CROSS JOIN qn {extra} GROUP BY parts.ID""")


@oracle("d2_term_analyzed")
def _d2_analyzed():
    return _d2()


@oracle("d4_or_analyzed")
def _d4_analyzed():
    return _or2()


@oracle("d7_nested_scores")
def _d7_scores():
    return _or2("WHERE parts.ID NOT IN (SELECT ID FROM dt WHERE term = 'tion')")


@oracle("d8_phrase_analyzed")
def _d8_analyzed():
    return base(f""",{idf_cte('i1', 'attion')}, {idf_cte('i2', 'thanedble')},
f AS (SELECT a.ID, COUNT(*) AS freq FROM tok a JOIN tok b ON a.ID = b.ID AND b.pos = a.pos + 2
      WHERE a.term = 'attion' AND b.term = 'thanedble' GROUP BY a.ID)
SELECT f.ID, round(sqrt(freq) * (i1.idf + i2.idf) / sqrt(ds.len), 6) AS score
FROM f JOIN ds USING (ID) CROSS JOIN i1 CROSS JOIN i2""")


@oracle("d10_prefix_scores")
def _d10_scores():
    return base("SELECT DISTINCT ID, CAST(1.0 AS DOUBLE) AS score FROM dt WHERE starts_with(term, 'tion')")


@oracle("d12_fuzzy_scores")
def _d12_scores():
    return base(f""",{idf_cte('i1', 'des')}, qn AS (SELECT 1 / sqrt(1 + i1.idf * i1.idf) AS qnorm FROM i1),
parts AS (SELECT DISTINCT dt.ID, CAST(1.0 AS DOUBLE) AS s FROM dt WHERE levenshtein(term, 'eriner') <= 1
          UNION ALL SELECT dt.ID, sqrt(tf) * i1.idf * i1.idf / sqrt(ds.len) AS s
          FROM dt JOIN ds USING (ID) CROSS JOIN i1 WHERE dt.term = 'des')
SELECT ID, round(SUM(s) * MAX(qnorm) * COUNT(*) / 2.0, 6) AS score FROM parts CROSS JOIN qn GROUP BY ID""")


BOOKMARKS = """bm AS (SELECT 'note ' || CAST(k AS VARCHAR) AS Comment, CAST(1500000000000 + k * 1000 AS BIGINT) AS Created, ev.ID
       FROM ev, (VALUES (0), (1), (2), (3), (4), (25)) t(k)
       WHERE (CAST(ev.ID AS BIGINT) // 2) % 25 = k % 25)"""


def merged(*lists: list[str]) -> list[str]:
    """CTE lists in order, shared ones once."""
    return list(dict.fromkeys(x for part in lists for x in part))


# ------------------------------------------------------------ E: ranking

def flagship_scores() -> list[str]:
    return [EVIDENCE, TOKENS, DOC_TERMS, or_query_scores(FLAGSHIP),
            "r AS (SELECT ID, round(score, 6) AS score FROM sc)"]


@oracle("e2_total_hits")
def _e2():
    return with_ctes(*flagship_scores(), body="SELECT COUNT(*) AS total_hits FROM r")


@oracle("e4_page")
def _e4():
    return with_ctes(*flagship_scores(),
                     body="SELECT ID, score FROM r ORDER BY score DESC, CAST(ID AS BIGINT) LIMIT 20 OFFSET 10")




@oracle("e6_files_view")
def _e6():
    return with_ctes(*merged(flagship_scores(), som_ctes(), [BOOKMARKS]), body="""
SELECT p.ID IN (SELECT ID FROM bm) AS selected, p.ID, p.score, ev.name, ev.path, ev.extension, ev.size,
       ev.modified * 1000 AS modified_ms, ev.accessed * 1000 AS accessed_ms, ev.created * 1000 AS created_ms,
       fin.cell, round(fin.som_cell_distance, 6) AS som_cell_distance
FROM (SELECT * FROM r ORDER BY score DESC, CAST(ID AS BIGINT) LIMIT 20) p JOIN ev USING (ID) JOIN fin USING (ID)""")


@oracle("e5_needed_fields")
def _e5():
    return with_ctes(*flagship_scores(), body="SELECT r.ID, r.score, ev.name, ev.size FROM r JOIN ev USING (ID)")


@oracle("e7_result_page")
def _e7():
    return with_ctes(*flagship_scores(), body="""
SELECT p.ID, p.score, ev.name, ev.path, ev.extension, ev.size, ev.modified, ev.accessed, ev.created
FROM (SELECT * FROM r ORDER BY score DESC, CAST(ID AS BIGINT) LIMIT 20 OFFSET 20) p JOIN ev USING (ID)""")


@oracle("a5_open_index")
def _a5():
    return with_ctes(EVIDENCE, body="SELECT md5('evidence') AS Id, COUNT(*) AS NumDocs FROM ev")


@oracle("a5_describe")
def _a5_describe():
    return with_ctes(EVIDENCE, body="SELECT true AS id_of_path, COUNT(*) AS NumDocs, '' AS error FROM ev "
                                    "UNION ALL SELECT true, NULL, 'no finished index'")


@oracle("a14_fetch_document")
def _a14():
    return with_ctes(EVIDENCE, body="SELECT ID, name, path, body_len, body FROM ev WHERE ID = '42'")


# ------------------------------------------------------------ F: hits

def _contains_any(col: str, items) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(d)})" for d in items) + ")"


def _isin(col: str, items) -> str:
    return f"{col} IN (" + ", ".join(q(i) for i in items) + ")"


def hits_ctes(terms: list[str] | str, ref_ms: int = 1400000000000) -> list[str]:
    tok_start = q("^[\\p{L}\\p{M}\\p{N}_]")
    feats_a = " + ".join(f"{f} * ({w!r})" for f, w in zip(
        ["f_" + x for x in K.HIT_FEATURES], K.ALLOCATED_WEIGHTS))
    feats_u = " + ".join(f"{f} * ({w!r})" for f, w in zip(
        ["f_" + x for x in K.HIT_FEATURES], K.UNALLOCATED_WEIGHTS))

    def esc(x):
        return (f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
                f"'\"', '&quot;')")

    def ddiff(c):
        return (f"CASE WHEN NOT ev.is_unallocated THEN abs(ev.{c} * 1000 - {ref_ms}) / {ref_ms}.0 "
                f"ELSE 0.0 END")

    low = "lower(ev.extension)"
    return [EVIDENCE, TOKENS, DOC_TERMS, f"""qt AS ({terms if isinstance(terms, str) else f'SELECT DISTINCT unnest({sql_list(terms)}) AS term'}),
corp AS (SELECT (SELECT n FROM nd) AS n, (SELECT SUM(ttf) FROM ts) AS tokens),
qs AS (SELECT qt.term, CAST(strlen(qt.term) AS INTEGER) AS term_len,
              CASE WHEN ts.ttf > 0 THEN -ln(ts.ttf / corp.tokens) * ln(corp.n / (1.0 + ts.df)) END AS tfidf
       FROM qt CROSS JOIN corp LEFT JOIN ts ON ts.term = qt.term),
qagg AS (SELECT COUNT(*) AS nq, greatest(0.0, COALESCE(MAX(tfidf), 0.0)) AS max_tfidf,
                COALESCE(MAX(term_len), 0) AS max_len FROM qs),
res AS (SELECT DISTINCT ID FROM dt WHERE term IN (SELECT term FROM qt)),
sent0 AS (SELECT ID, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS s_idx
          FROM (SELECT ID, {sentences("body")} AS a
                FROM ev WHERE ID IN (SELECT ID FROM res))),
sent AS (SELECT *, CAST(SUM(length(sentence)) OVER (PARTITION BY ID ORDER BY s_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s_end
         FROM sent0),
sent2 AS (SELECT ID, s_idx, sentence, s_end, s_end - length(sentence) AS s_start FROM sent),
pc AS (SELECT ID, s_idx, sentence, s_start, s_end, unnest(a) AS piece, generate_subscripts(a, 1) AS k
       FROM (SELECT *, regexp_extract_all(sentence, {q(TOKEN_OR_GAP_RE)}) AS a FROM sent2)),
pc2 AS (SELECT *, CAST(SUM(length(piece)) OVER (PARTITION BY ID, s_idx ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rel_end
        FROM pc),
mt AS (SELECT pc2.ID, s_idx, sentence, s_start, s_end, lower(piece) AS term,
              rel_end - length(piece) AS rel_start, rel_end, s_start + rel_end - length(piece) AS m_start,
              qs.tfidf, qs.term_len
       FROM pc2 JOIN qs ON lower(pc2.piece) = qs.term
       WHERE regexp_matches(piece, {tok_start}) AND qs.tfidf IS NOT NULL),
mtf AS (SELECT *, COUNT(*) OVER (PARTITION BY ID, term) AS tf,
               lag(rel_end, 1, 0) OVER (PARTITION BY ID, s_idx ORDER BY rel_start) AS prev_end FROM mt),
ps AS (SELECT ID, s_idx, MIN(s_start) AS s_start, MIN(s_end) AS s_end,
              MIN(m_start) AS first_match, MAX(m_start) AS last_match,
              list_sort(list_distinct(list(term))) AS terms, MAX(tf) AS max_hit_tf,
              greatest(0.0, MAX(tfidf)) AS max_hit_tfidf, MAX(term_len) AS max_hit_len,
              string_agg({esc('substring(sentence, prev_end + 1, rel_start - prev_end)')}
                         || {q(K.HIGHLIGHT_OPEN)}
                         || {esc('substring(sentence, rel_start + 1, rel_end - rel_start)')}
                         || {q(K.HIGHLIGHT_CLOSE)}, '' ORDER BY rel_start)
                || {esc('substring(MIN(sentence), MAX(rel_end) + 1)')} AS snippet
       FROM mtf GROUP BY ID, s_idx),
b1 AS (SELECT ps.*, ev.body_len, array_to_string(terms, chr(1)) AS tkey,
              lead(array_to_string(terms, chr(1))) OVER w AS nkey, lead(len(terms)) OVER w AS nn,
              lead(first_match) OVER w AS nxt_first
       FROM ps JOIN ev USING (ID) WINDOW w AS (PARTITION BY ID ORDER BY s_idx)),
b2 AS (SELECT *, COALESCE(nkey IS NOT NULL AND (len(terms) > 1 OR nn > 1 OR tkey <> nkey), false) AS b FROM b1),
b3 AS (SELECT *,
         MIN(CASE WHEN b THEN nxt_first END) OVER (PARTITION BY ID ORDER BY s_idx
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_first,
         MAX(CASE WHEN b THEN last_match END) OVER (PARTITION BY ID ORDER BY s_idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_last FROM b2),
b4 AS (SELECT *, least(COALESCE(first_match - prev_last, body_len),
                       COALESCE(next_first - first_match, body_len)) AS distance FROM b3),
pt AS (SELECT ID, term, COUNT(*) AS tf FROM mt GROUP BY ID, term),
pd AS (SELECT ID, SUM(tf) AS dot, COUNT(*) AS present, MAX(tf) AS max_doc_tf FROM pt GROUP BY ID),
dfe AS (SELECT ev.ID, ev.is_unallocated, pd.max_doc_tf,
          {ddiff('created')} AS f_created, {ddiff('modified')} AS f_modified, {ddiff('accessed')} AS f_accessed,
          0.0 AS f_filename_direct,
          CASE WHEN NOT ev.is_unallocated AND EXISTS (SELECT 1 FROM qt WHERE instr(ev.path || ev.name, qt.term) > 1)
               THEN 1.0 ELSE 0.0 END AS f_filename_indirect,
          CASE WHEN NOT ev.is_unallocated AND {_contains_any('ev.path', K.SYSTEM_DIRS)} THEN 1.0 ELSE 0.0 END
            AS f_system_dir,
          CASE WHEN {_isin(low, K.HIGH_PRIORITY_TYPES)} THEN 1.0 ELSE 0.0 END AS f_high_type,
          CASE WHEN {_isin(low, K.MED_PRIORITY_TYPES)} THEN 1.0 ELSE 0.0 END AS f_med_type,
          CASE WHEN {_isin(low, K.HIGH_PRIORITY_TYPES)} OR {_isin(low, K.MED_PRIORITY_TYPES)}
               THEN 0.0 ELSE 1.0 END AS f_low_type,
          pd.dot / (sqrt(ds.sum_tf2) + sqrt(pd.present)) AS f_similarity,
          pd.present / qagg.nq AS f_term_cardinality
        FROM ev JOIN pd ON pd.ID = ev.ID JOIN ds ON ds.ID = ev.ID CROSS JOIN qagg),
dfe2 AS (SELECT *, (f_created + f_modified + f_accessed) / 3 AS f_avg_recency FROM dfe),
hf AS (SELECT b4.ID, b4.s_idx, b4.s_start, b4.s_end, b4.snippet, dfe2.*  EXCLUDE (ID),
          CASE WHEN qagg.max_tfidf = 0 THEN 0.0 ELSE max_hit_tfidf / qagg.max_tfidf END AS f_term_tfidf,
          CASE WHEN max_doc_tf = 0 THEN 0.0 ELSE max_hit_tf / max_doc_tf END AS f_hit_frequency,
          distance / (CASE WHEN body_len = 0 THEN 1 ELSE body_len END) AS f_proximity,
          CASE WHEN qagg.max_len = 0 THEN 0.0 ELSE max_hit_len / qagg.max_len END AS f_term_length,
          0.0 AS f_term_priority, 0.0 AS f_unused,
          b4.s_start / (CASE WHEN body_len = 0 THEN 1 ELSE body_len END) AS f_hit_offset
       FROM b4 JOIN dfe2 ON dfe2.ID = b4.ID CROSS JOIN qagg),
rawh AS (SELECT *, CASE WHEN is_unallocated THEN {feats_u} ELSE {feats_a} END AS raw_score FROM hf),
rng AS (SELECT is_unallocated, MIN(raw_score) AS min_score, MAX(raw_score) AS max_score,
               MAX(raw_score) - MIN(raw_score) AS score_range FROM rawh GROUP BY is_unallocated),
hits AS (SELECT rawh.*, 10.0 * (raw_score - min_score) / CASE WHEN score_range = 0 THEN 1.0 ELSE score_range END AS score
         FROM rawh JOIN rng USING (is_unallocated))"""]


def _r(cols):
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)


@oracle("f1_sentences")
def _f1():
    return with_ctes(EVIDENCE, f"""sent0 AS (SELECT ID, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS s_idx
          FROM (SELECT ID, {sentences("body")} AS a FROM ev)),
sent AS (SELECT *, CAST(SUM(length(sentence)) OVER (PARTITION BY ID ORDER BY s_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s_end
         FROM sent0)""", body="""SELECT ID, CAST(s_idx AS INTEGER) AS s_idx,
       CAST(s_end - length(sentence) AS BIGINT) AS s_start, CAST(s_end AS BIGINT) AS s_end FROM sent""")


def _hits_sql(body: str) -> str:
    return with_ctes(*hits_ctes(FLAGSHIP), body=body)


@oracle("f2_hit_sentences")
def _f2():
    return _hits_sql("SELECT ID, CAST(s_idx AS INTEGER) AS s_idx, CAST(s_start AS BIGINT) AS s_start, "
                     "CAST(s_end AS BIGINT) AS s_end, CAST(first_match AS BIGINT) AS first_match, "
                     "CAST(last_match AS BIGINT) AS last_match FROM ps")


@oracle("f2_dotted_hits")
def _f2_dotted():
    terms = "SELECT term FROM ts WHERE regexp_full_match(term, '[a-z0-9]+\\.example\\.com')"
    return with_ctes(*hits_ctes(terms), body="""
SELECT b4.ID, CAST(s_idx AS INTEGER) AS s_idx, CAST(s_start AS BIGINT) AS s_start, CAST(s_end AS BIGINT) AS s_end,
       CAST(first_match AS BIGINT) AS first_match, array_to_string(terms, ' ') AS terms,
       CAST((SELECT SUM(tf) FROM dt WHERE dt.ID = b4.ID AND dt.term IN (SELECT term FROM qt)) AS BIGINT) AS dot FROM b4""")


@oracle("f3_term_sets")
def _f3():
    return _hits_sql("SELECT ID, CAST(s_idx AS INTEGER) AS s_idx, array_to_string(terms, ' ') AS terms FROM ps")


@oracle("f4_f6_boundaries")
def _f4():
    return _hits_sql("SELECT ID, CAST(s_idx AS INTEGER) AS s_idx, CAST(next_first AS BIGINT) AS next_first, "
                     "CAST(prev_last AS BIGINT) AS prev_last, CAST(distance AS BIGINT) AS distance FROM b4")


@oracle("f7_snippet")
def _f7():
    return _hits_sql("SELECT ID, CAST(s_idx AS INTEGER) AS s_idx, snippet FROM ps")


@oracle("f8_query_term_weights")
def _f8():
    return _hits_sql("SELECT term, term_len, round(tfidf, 6) AS tfidf, round(max_tfidf, 6) AS max_tfidf, "
                     "max_len FROM qs CROSS JOIN qagg WHERE tfidf IS NOT NULL")


_DOCF = ["f_created", "f_modified", "f_accessed", "f_avg_recency", "f_filename_direct",
         "f_filename_indirect", "f_system_dir", "f_high_type", "f_med_type", "f_low_type",
         "f_similarity", "f_term_cardinality"]
_HITF = ["f_term_tfidf", "f_hit_frequency", "f_proximity", "f_term_length",
         "f_term_priority", "f_unused", "f_hit_offset", "raw_score"]


@oracle("f9_f17_doc_features")
def _f9():
    return _hits_sql(f"SELECT ID, {_r(_DOCF)}, max_doc_tf FROM dfe2")


@oracle("f18_f24_hit_features")
def _f18():
    return _hits_sql(f"SELECT ID, CAST(s_idx AS INTEGER) AS s_idx, {_r(_HITF)} FROM rawh")


@oracle("f25_score_ranges")
def _f25():
    return _hits_sql(f"SELECT is_unallocated, {_r(['min_score', 'max_score', 'score_range'])} FROM rng")


@oracle("f26_normalized_scores")
def _f26():
    return _hits_sql("SELECT ID, CAST(s_idx AS INTEGER) AS s_idx, is_unallocated, round(score, 6) AS score FROM hits")


@oracle("f27_f28_hits_page")
def _f27():
    return with_ctes(*merged(hits_ctes(FLAGSHIP), som_ctes()), body="""SELECT h.ID, round(h.score, 6) AS score, ev.name, h.snippet AS passage,
       CAST(h.s_start AS BIGINT) AS start, CAST(h.s_end AS BIGINT) AS "end", ev.path, ev.extension, ev.size,
       ev.modified * 1000 AS modified, ev.accessed * 1000 AS accessed, ev.created * 1000 AS created,
       fin.cell, round(fin.som_cell_distance, 6) AS som_cell_distance
FROM hits h JOIN ev USING (ID) JOIN fin USING (ID)
ORDER BY round(h.score, 6) DESC, CAST(h.ID AS BIGINT), h.s_start LIMIT 20""")


@oracle("f29_docs_with_hits")
def _f29():
    return _hits_sql("SELECT COUNT(DISTINCT ID) AS num_docs FROM hits")


@oracle("f31_query_terms")
def _f31():
    return base("SELECT unnest(['from', 'tion', 'des']) AS term UNION "
                "SELECT term FROM ts WHERE starts_with(term, 'eriner')")


# ------------------------------------------------------------ G: clustering
# 3×3 map, 20 features, 2 epochs (alpha 0.05 → 0.01, radius 1 → 0), seed 17.

SOM_W, SOM_H, SOM_K, SOM_SEED, SOM_TOP = 3, 3, 20, 17, 5
SOM_EPOCHS = [(0.05, 1), (0.05 - (0.05 - 0.01), 0)]


def _epoch(e: int, alpha: float, radius: int) -> str:
    return f"""s2_{e} AS (SELECT cell, SUM(w * w) AS s2 FROM w{e} GROUP BY cell),
d_{e} AS (SELECT v.ID, w.cell, MAX(vs.k) + MAX(s.s2) - 2 * SUM(w.w) AS d
          FROM vec v JOIN w{e} w ON w.idx = v.idx JOIN vsize vs ON vs.ID = v.ID JOIN s2_{e} s ON s.cell = w.cell
          GROUP BY v.ID, w.cell),
win_{e} AS (SELECT ID, cell AS winner, greatest(d, 0.0) AS dist FROM (
            SELECT ID, cell, d, row_number() OVER (PARTITION BY ID ORDER BY d, cell) AS rn FROM d_{e}) WHERE rn = 1),
nb_{e} AS (SELECT c.cell, x.ID FROM cells c JOIN win_{e} x
           ON abs(c.cell % {SOM_W} - x.winner % {SOM_W}) <= {radius}
          AND abs(c.cell // {SOM_W} - x.winner // {SOM_W}) <= {radius}),
n_{e} AS (SELECT cell, COUNT(*) AS n FROM nb_{e} GROUP BY cell),
m_{e} AS (SELECT nb.cell, v.idx, COUNT(*) AS m FROM nb_{e} nb JOIN vec v ON v.ID = nb.ID GROUP BY nb.cell, v.idx),
w{e + 1} AS (SELECT w.cell, w.idx,
               CASE WHEN COALESCE(n.n, 0) > 0
                    THEN pow(1 - CAST({alpha!r} AS DOUBLE), n.n) * w.w
                         + (1 - pow(1 - CAST({alpha!r} AS DOUBLE), n.n)) * COALESCE(m.m, 0) / n.n
                    ELSE w.w END AS w
             FROM w{e} w LEFT JOIN n_{e} n ON n.cell = w.cell
             LEFT JOIN m_{e} m ON m.cell = w.cell AND m.idx = w.idx)"""


def _final(e: int) -> str:
    return f"""s2_{e} AS (SELECT cell, SUM(w * w) AS s2 FROM w{e} GROUP BY cell),
d_{e} AS (SELECT v.ID, w.cell, MAX(vs.k) + MAX(s.s2) - 2 * SUM(w.w) AS d
          FROM vec v JOIN w{e} w ON w.idx = v.idx JOIN vsize vs ON vs.ID = v.ID JOIN s2_{e} s ON s.cell = w.cell
          GROUP BY v.ID, w.cell),
win_{e} AS (SELECT ID, cell AS winner, greatest(d, 0.0) AS dist FROM (
            SELECT ID, cell, d, row_number() OVER (PARTITION BY ID ORDER BY d, cell) AS rn FROM d_{e}) WHERE rn = 1)"""


def som_ctes() -> list[str]:
    n = len(SOM_EPOCHS)
    epochs = [_epoch(e, a, r) for e, (a, r) in enumerate(SOM_EPOCHS)] + [_final(n)]
    return [EVIDENCE, TOKENS, DOC_TERMS, f"""feats AS (
  SELECT term, df, CAST(row_number() OVER (ORDER BY df DESC, term) - 1 AS INTEGER) AS idx
  FROM (SELECT term, df FROM ts, nd
        WHERE df / nd.n >= 1e-4 AND df / nd.n <= 0.66 AND length(term) >= 3
        ORDER BY df DESC, term LIMIT {SOM_K})),
dims AS (SELECT COUNT(*) AS k FROM feats),
vec AS (SELECT dt.ID, f.idx FROM dt JOIN feats f ON f.term = dt.term),
vsize AS (SELECT ID, COUNT(*) AS k FROM vec GROUP BY ID),
cells AS (SELECT CAST(c AS INTEGER) AS cell FROM range(0, {SOM_W * SOM_H}) t(c)),
w0 AS (SELECT cell, CAST(i AS INTEGER) AS idx,
              ((cell * 7919 + i * 104729 + {SOM_SEED * 31}) % 1000003) / 1000003.0 AS w
       FROM cells, range(0, (SELECT k FROM dims)) r(i))""", *epochs, f"""fin AS (
  SELECT ev.ID, COALESCE(CAST(x.winner AS VARCHAR), '-1') AS cell,
         CAST(x.winner % {SOM_W} AS INTEGER) AS som_x, CAST(x.winner // {SOM_W} AS INTEGER) AS som_y,
         x.dist AS som_cell_distance
  FROM ev LEFT JOIN win_{n} x ON x.ID = ev.ID),
stats AS (SELECT c.cell, COUNT(f.ID) AS num, COALESCE(SUM(f.som_cell_distance * f.som_cell_distance), 0.0) AS ssd
          FROM cells c LEFT JOIN fin f ON f.cell = CAST(c.cell AS VARCHAR) GROUP BY c.cell),
stats2 AS (SELECT *, sqrt(CASE WHEN num > 2 THEN ssd / (num - 1) ELSE ssd END) AS std_dev FROM stats),
tops AS (SELECT cell, CAST(rk - 1 AS INTEGER) AS rank, term FROM (
           SELECT w.cell, f.term, row_number() OVER (PARTITION BY w.cell ORDER BY CAST(trunc(w.w * 1000) AS INTEGER) DESC, w.idx) AS rk
           FROM w{n} w JOIN feats f ON f.idx = w.idx) WHERE rk <= {SOM_TOP}),
firsts AS (SELECT cell, term FROM tops WHERE rank = 0),
rid AS (SELECT term, CAST(row_number() OVER (ORDER BY MIN(cell)) - 1 AS INTEGER) AS region FROM firsts GROUP BY term),
regs AS (SELECT f.cell, r.region FROM firsts f JOIN rid r ON r.term = f.term),
pairs AS (SELECT a.cell AS a, b.cell AS b FROM cells a, cells b
          WHERE a.cell <> b.cell AND abs(a.cell % {SOM_W} - b.cell % {SOM_W}) <= 1
            AND abs(a.cell // {SOM_W} - b.cell // {SOM_W}) <= 1),
adj AS (SELECT DISTINCT ra.region, rb.region AS other FROM pairs p
        JOIN regs ra ON ra.cell = p.a JOIN regs rb ON rb.cell = p.b WHERE ra.region <> rb.region),
wd AS (SELECT p.a, p.b, wa.idx, wa.w - wb.w AS d FROM pairs p
       JOIN w{n} wa ON wa.cell = p.a JOIN w{n} wb ON wb.cell = p.b AND wb.idx = wa.idx WHERE p.a < p.b),
wdx AS (SELECT a, b, MAX(d) AS mx, MIN(d) AS mn FROM wd GROUP BY a, b),
diffs AS (SELECT x.a, x.b, f.term, CASE WHEN x.mn < 0 AND abs(x.mn) > x.mx THEN -1 ELSE 1 END AS sign
          FROM wdx x JOIN feats f ON f.idx = (
            SELECT MIN(idx) FROM wd WHERE wd.a = x.a AND wd.b = x.b
              AND wd.d = CASE WHEN x.mn < 0 AND abs(x.mn) > x.mx THEN x.mn ELSE x.mx END)),
sdiffs AS (SELECT a, b, term, sign FROM diffs UNION ALL SELECT b AS a, a AS b, term, -sign AS sign FROM diffs)"""]


def _som(body: str) -> str:
    return with_ctes(*som_ctes(), body=body)


@oracle("g1_feature_terms")
def _g1():
    return _som("SELECT term, df FROM feats")


@oracle("g2_feature_index")
def _g2():
    return _som("SELECT term, idx FROM feats")


@oracle("g3_doc_vectors")
def _g3():
    return _som("""SELECT ev.ID, COALESCE(array_to_string(list(CAST(v.idx AS VARCHAR) ORDER BY v.idx)
                                              FILTER (WHERE v.idx IS NOT NULL), ','), '') AS features
FROM ev LEFT JOIN vec v ON v.ID = ev.ID GROUP BY ev.ID""")


@oracle("g4_outliers")
def _g4():
    return _som("SELECT ID FROM ev WHERE ID NOT IN (SELECT ID FROM vec)")


@oracle("g5_vector_stats")
def _g5():
    return _som("""SELECT (SELECT COUNT(*) FROM ev) AS num_docs,
       (SELECT COUNT(*) FROM ev WHERE ID NOT IN (SELECT ID FROM vsize)) AS num_outliers,
       CAST((SELECT MAX(k) FROM vsize) AS INTEGER) AS max_doc_terms,
       round((SELECT AVG(k) FROM vsize), 6) AS avg_doc_terms""")


@oracle("g6_g7_initial_weights")
def _g6():
    return _som("""SELECT w0.cell, w0.idx, round(w0.w, 6) AS w, round(s.s2, 6) AS s2
FROM w0 JOIN (SELECT cell, SUM(w * w) AS s2 FROM w0 GROUP BY cell) s ON s.cell = w0.cell""")


@oracle("g8_distances")
def _g8():
    return _som("SELECT ID, cell, round(greatest(d, 0.0), 6) AS distance FROM d_0")


@oracle("g8_nearest_cells")
def _g8_nearest():
    return _som("""SELECT ID, CAST(row_number() OVER (PARTITION BY ID ORDER BY d, cell) AS INTEGER) AS rank, cell,
round(greatest(d, 0.0), 6) AS distance FROM d_0 QUALIFY rank <= 3""")


@oracle("g9_nearest_cell")
def _g9():
    return _som("SELECT ID, winner AS cell, round(dist, 6) AS distance FROM win_0")


@oracle("g10_neighbourhood_counts")
def _g10():
    return _som("SELECT cell, n FROM n_0")


@oracle("g11_epoch_update")
def _g11():
    return _som("SELECT cell, idx, round(w, 6) AS w FROM w1")


@oracle("g12_trained_weights")
def _g12():
    return _som(f"SELECT cell, idx, round(w, 6) AS w FROM w{len(SOM_EPOCHS)}")


@oracle("g13_epoch_counts")
def _g13():
    rows = " UNION ALL ".join(
        f"SELECT {e} AS epoch, round(CAST({a!r} AS DOUBLE), 6) AS alpha, {r} AS radius" for e, (a, r) in
        enumerate(SOM_EPOCHS))
    return _som(f"""SELECT e.epoch, e.alpha, e.radius, (SELECT COUNT(*) FROM ev) AS docs,
       (SELECT COUNT(*) FROM vsize) AS matched FROM ({rows}) e""")


@oracle("g14_assignments")
def _g14():
    return _som("SELECT ID, cell, som_x, som_y, round(som_cell_distance, 6) AS som_cell_distance FROM fin")


@oracle("g15_cell_stats")
def _g15():
    return _som("SELECT cell, num, round(ssd, 6) AS ssd, round(std_dev, 6) AS std_dev FROM stats2")


@oracle("g17_top_terms")
def _g17():
    return _som("SELECT cell, rank, term FROM tops")


@oracle("g18_regions")
def _g18():
    return _som("SELECT cell, region FROM regs")


@oracle("g19_region_adjacency")
def _g19():
    return _som("SELECT region, other FROM adj")


@oracle("g21_term_diffs")
def _g21():
    return _som("SELECT a, b, term, sign FROM diffs")


@oracle("g22_signed_diffs")
def _g22():
    return _som("SELECT a, b, term, sign FROM sdiffs")


@oracle("g23_map_summary")
def _g23():
    return _som("""SELECT COUNT(*) FILTER (WHERE num = 0) AS num_zero,
       COUNT(*) FILTER (WHERE num > 0) AS num_with,
       CAST(COALESCE(SUM(num) FILTER (WHERE num > 0), 0) AS BIGINT) AS total_with,
       CAST((SELECT COUNT(*) FROM fin WHERE cell = '-1') AS BIGINT) AS num_outliers,
       round(SUM(ssd), 6) AS ssd,
       (SELECT COUNT(DISTINCT region) FROM regs) AS num_regions,
       MAX(num) AS max_cell_num, round(MAX(ssd), 6) AS max_cell_ssd, round(MAX(std_dev), 6) AS max_cell_std,
       round(CASE WHEN COUNT(*) FILTER (WHERE num > 0) = 0 THEN 0.0
                  ELSE SUM(num) FILTER (WHERE num > 0) / COUNT(*) FILTER (WHERE num > 0) END, 6) AS avg_num
FROM stats2""")


@oracle("g24_cell_info")
def _g24():
    return _som("""SELECT s.cell, s.num, r.region,
       (SELECT string_agg(term, ', ' ORDER BY rank) FROM tops t WHERE t.cell = s.cell) AS top_terms,
       round(s.std_dev, 6) AS std_dev, round(s.ssd, 6) AS ssd,
       (SELECT string_agg(CAST(d.b AS VARCHAR) || ':' || CASE WHEN d.sign < 0 THEN '-' ELSE '' END || d.term, ' '
                          ORDER BY d.b) FROM sdiffs d WHERE d.a = s.cell) AS neighbour_terms
FROM stats2 s LEFT JOIN regs r ON r.cell = s.cell""")


@oracle("g25_saturation")
def _g25():
    return _som("""SELECT cell, round(100.0 * (mx - std_dev) / mx, 6) AS saturation
FROM stats2, (SELECT MAX(std_dev) AS mx FROM stats2) m""")


COLORS = """nreg AS (SELECT COUNT(DISTINCT region) AS n FROM regs),
adjl AS (SELECT t.r AS region, list(adj.other) FILTER (WHERE adj.other < t.r) AS others
         FROM (SELECT unnest(range(0, (SELECT n FROM nreg))) AS r) t LEFT JOIN adj ON adj.region = t.r GROUP BY t.r),
painted AS (SELECT 0 AS region, [0] AS cols
            UNION ALL SELECT a.region, list_append(p.cols, COALESCE(
                [c FOR c IN range(9) IF NOT list_contains([p.cols[o + 1] FOR o IN COALESCE(a.others, [])], c)][1], a.region % 9))
            FROM painted p JOIN adjl a ON a.region = p.region + 1),
colored AS (SELECT region, CAST(cols[region + 1] AS INTEGER) AS color FROM painted)"""


def _colored(body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([*som_ctes(), COLORS]) + "\n" + body


@oracle("a8_map_facts")
def _a8_map_facts():
    return _colored("""SELECT 'cell' AS kind, CAST(s.cell AS BIGINT) AS a, CAST(s.num AS BIGINT) AS b,
       (SELECT string_agg(term, ' ' ORDER BY rank) FROM tops t WHERE t.cell = s.cell) AS text FROM stats2 s
UNION ALL SELECT 'region', cell, region, NULL FROM regs
UNION ALL SELECT 'color', region, color, NULL FROM colored
UNION ALL SELECT 'neighbour', region, other, NULL FROM adj
UNION ALL SELECT 'difference', a, b, CASE WHEN sign < 0 THEN '-' ELSE '' END || term FROM sdiffs WHERE a < b""")


@oracle("g20_region_colors")
def _g20():
    return _colored("SELECT CAST(region AS INTEGER) AS region, color FROM colored")


@oracle("g25_hue")
def _g25_hue():
    return _colored("SELECT cell, color * 40 AS hue FROM regs JOIN colored USING (region)")


@oracle("g26_luminance")
def _g26():
    return _som("""SELECT DISTINCT num, round(CASE WHEN num = 0 THEN 100.0
       ELSE 95.0 - (le - 1 - i0) * (60.0 / (n - i0)) END, 6) AS luminance
FROM (SELECT num, COUNT(*) OVER (ORDER BY num RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le,
             COUNT(*) OVER () AS n FROM stats2) x,
     (SELECT COUNT(*) - 1 AS i0 FROM stats2 WHERE num <= (SELECT MIN(num) FROM stats2 WHERE num > 0)) y""")


@oracle("g27_result_distribution")
def _g27():
    return _som("""SELECT f.cell, r.region, COUNT(*) AS n
FROM (SELECT DISTINCT ID FROM dt WHERE term IN ('from', 'tion', 'des')) res
JOIN fin f ON f.ID = res.ID LEFT JOIN regs r ON CAST(r.cell AS VARCHAR) = f.cell
GROUP BY f.cell, r.region""")


@oracle("g28_cell_members")
def _g28():
    return _som("""SELECT ID, round(som_cell_distance, 6) AS som_cell_distance FROM fin
WHERE cell = '8' AND som_cell_distance >= 0.5 AND som_cell_distance <= 20.0""")


@oracle("d16_cell_clause")
def _d16():
    return _som("SELECT ID FROM fin WHERE cell = '8' UNION SELECT ID FROM dt WHERE term = 'anea'")


@oracle("d17_outliers")
def _d17():
    return _som("SELECT ID FROM fin WHERE cell = '-1'")


@oracle("h9_som_join")
def _h9():
    return _som("""SELECT ev.ID, ev.name, f.cell, f.som_x, f.som_y, round(f.som_cell_distance, 6) AS som_cell_distance
FROM ev LEFT JOIN fin f ON f.ID = ev.ID""")


# ------------------------------------------------------------ B: records → documents

from .functions.text import HTML_SCRIPT_RE, HTML_STYLE_RE, HTML_TAG_RE, WHITESPACE_RUN  # noqa: E402

RECORDS = """rec AS (
  SELECT CAST(ID AS BIGINT) // 2 AS seq, ev.*, CAST(strlen(body) AS BIGINT) AS total,
         CAST(CASE WHEN (CAST(ID AS BIGINT) // 2) % 10 = 0 AND strlen(body) > 200 THEN strlen(body) - 200
                   ELSE strlen(body) END AS BIGINT) AS msize
  FROM ev),
rdocs AS (
  SELECT CAST(seq * 2 AS VARCHAR) AS ID, name, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS extension,
         least(total, msize) AS size, path, false AS is_slack FROM rec
  UNION ALL
  SELECT CAST(seq * 2 + 1 AS VARCHAR) AS ID, name || ':slack' AS name, '' AS extension,
         total - msize AS size, path, true AS is_slack FROM rec WHERE total > msize)"""


def _rec(body: str) -> str:
    return with_ctes(EVIDENCE, RECORDS, body=body)


@oracle("b1_parse_metadata")
def _b1():
    return _rec("SELECT seq, path, name, least(total, msize) AS file_size, "
                "greatest(total - msize, 0) AS slack_size FROM rec")


@oracle("b2_flatten_metadata")
def _b2():
    return """
SELECT event_id, key,
       CASE WHEN json_type(v) IN ('BIGINT', 'UBIGINT', 'DOUBLE')
            THEN CAST(CAST(trunc(CAST(v AS DOUBLE)) AS BIGINT) AS VARCHAR)
            ELSE json_extract_string(v, '$') END AS value
FROM (SELECT event_id, k AS key, json_extract(props, '$."' || k || '"') AS v
      FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events))
WHERE json_type(v) NOT IN ('BOOLEAN', 'NULL')"""


@oracle("b3_full_path")
def _b3():
    return _rec("SELECT seq, path || name AS full_path FROM rec")


@oracle("b4_extension")
def _b4():
    return _rec("SELECT ID, name, extension FROM rdocs")


@oracle("b5_unallocated")
def _b5():
    return _rec("SELECT ID, starts_with(path, '$Unallocated/') AS is_unallocated FROM rdocs")


@oracle("b6_slack_docs")
def _b6():
    return _rec("SELECT ID, name, extension, size, is_slack FROM rdocs WHERE is_slack")


@oracle("b7_html_text")
def _b7():
    t = f"regexp_replace(html, {q(HTML_SCRIPT_RE)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(HTML_STYLE_RE)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(HTML_TAG_RE)}, ' ', 'g')"
    t = f"trim(regexp_replace({t}, {q(WHITESPACE_RUN)}, ' ', 'g'))"
    return f"SELECT page_id, {t} AS text FROM pages"


@oracle("b8_raw_text")
def _b8():
    return "SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f]', '', 'g') AS text FROM documents"


@oracle("b9_drop_empty")
def _b9():
    return with_ctes(EVIDENCE, TOKENS, body="SELECT ID FROM ev WHERE ID IN (SELECT ID FROM tok)")


@oracle("b10_body_len")
def _b10():
    return with_ctes(EVIDENCE, body="SELECT ID, CAST(length(body) AS BIGINT) AS body_len FROM ev")


@oracle("b11_byte_ngrams")
def _b11():
    nib = "(instr('0123456789ABCDEF', substring(hx, {p}, 1)) - 1)"
    byte = f"({nib.format(p='2 * i + 1')} * 16 + {nib.format(p='2 * i + 2')})"
    return f"""WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS ID, hex(encode(text)) AS hx, strlen(text) AS n
           FROM documents WHERE strlen(text) > 0),
idx AS (SELECT ID, hx, unnest(range(0, n)) AS i FROM h),
b AS (SELECT ID, i, {byte} AS b FROM idx),
nb AS (SELECT ID, b, lead(b) OVER (PARTITION BY ID ORDER BY i) AS nxt FROM b),
feat AS (SELECT ID, b AS feature FROM nb
         UNION ALL SELECT ID, 256 + b * 256 + nxt AS feature FROM nb WHERE nxt IS NOT NULL)
SELECT ID, CAST(feature AS INTEGER) AS feature, COUNT(*) AS count FROM feat GROUP BY ID, feature"""


CLASS_EXT = "[" + ", ".join(q("" if i == 0 else e) for i, e in enumerate(K.FILE_TYPE_CLASSES)) + "]"


@oracle("b13_class_extension")
def _b13():
    return f"""SELECT CAST(doc_id * 2 AS VARCHAR) AS ID, CAST(n_chars % 50 AS INTEGER) AS class,
       CASE WHEN n_chars % 50 BETWEEN 0 AND {len(K.FILE_TYPE_CLASSES) - 1}
            THEN {CLASS_EXT}[CAST(n_chars % 50 AS INTEGER) + 1] ELSE '' END AS class_extension
FROM documents"""


@oracle("b14_unallocated_override")
def _b14():
    return with_ctes(EVIDENCE, body=f"""SELECT ev.ID, CASE WHEN ev.is_unallocated THEN
         CASE WHEN d.n_chars % 50 BETWEEN 0 AND {len(K.FILE_TYPE_CLASSES) - 1}
              THEN {CLASS_EXT}[CAST(d.n_chars % 50 AS INTEGER) + 1] ELSE '' END
       ELSE ev.extension END AS extension
FROM ev JOIN documents d ON CAST(d.doc_id * 2 AS VARCHAR) = ev.ID""")


@oracle("b15_type_priority")
def _b15():
    return with_ctes(EVIDENCE, body=f"""SELECT ID, extension,
       CASE WHEN {_isin('lower(extension)', K.HIGH_PRIORITY_TYPES)} THEN 'high'
            WHEN {_isin('lower(extension)', K.MED_PRIORITY_TYPES)} THEN 'medium' ELSE 'low' END AS priority
FROM ev""")


@oracle("b16_ingest_counters")
def _b16():
    js = ("'{\"path\":\"' || path || '\",\"name\":{\"name\":\"' || name || '\"},\"meta\":{\"size\":' "
          "|| msize || ',\"mtime\":' || modified || ',\"crtime\":' || created || ',\"atime\":' || accessed || '}}'")
    return _rec(f"""SELECT COUNT(*) AS files_read, CAST(SUM(16 + strlen({js}) + total) AS BIGINT) AS bytes_read,
       CAST(SUM(total) AS BIGINT) AS file_bytes_read FROM rec""")


@oracle("b17_display_times")
def _b17():
    return with_ctes(EVIDENCE, body="SELECT ID, " + ", ".join(
        f"{c} * 1000 AS {c}_ms, strftime(make_timestamp({c} * 1000000), '%Y-%m-%d %H:%M:%S') AS {c}_str"
        for c in ("modified", "accessed", "created")) + " FROM ev")


# ------------------------------------------------------------ A: sources and sinks

@oracle("a1_dump_source")
def _a1():
    return with_ctes(EVIDENCE, body="SELECT name, path, CAST(strlen(body) AS BIGINT) AS content_len FROM ev")


@oracle("a2_record_ids")
def _a2():
    return ("SELECT i AS n, CAST(2 * i AS VARCHAR) AS file_id, CAST(2 * i + 1 AS VARCHAR) AS slack_id "
            "FROM range(0, (SELECT COUNT(*) FROM documents)) t(i)")


@oracle("a3_stop_list")
def _a3():
    return with_ctes(EVIDENCE, TOKENS, body="""SELECT term, COUNT(*) AS removed FROM raw_tok
WHERE term IN (SELECT term FROM stops) GROUP BY term""")


@oracle("a4_index_append")
def _a4():
    return base("SELECT term, df, CAST(ttf AS BIGINT) AS ttf FROM ts")




@oracle("a9_map_json_source")
def _a9():
    return _som(f"""SELECT CAST({SOM_W} AS BIGINT) AS width, CAST({SOM_H} AS BIGINT) AS height,
       COUNT(*) FILTER (WHERE num = 0) AS numZero, COUNT(*) FILTER (WHERE num > 0) AS numWith,
       (SELECT COUNT(*) FROM fin WHERE cell = '-1') AS numOutliers,
       (SELECT COUNT(DISTINCT region) FROM regs) AS numRegions, MAX(num) AS maxCellNum,
       CAST(COUNT(*) AS INTEGER) AS num_cells FROM stats2""")


@oracle("a10_document_csv")
def _a10():
    return with_ctes(*merged(flagship_scores(), som_ctes(), [BOOKMARKS]), body="""SELECT r.ID, r.score AS Score, ev.name AS Name,
       ev.path AS Path, ev.extension AS Extension, ev.size AS Size, ev.modified * 1000 AS Modified,
       ev.accessed * 1000 AS Accessed, ev.created * 1000 AS Created, fin.cell AS Cell,
       round(fin.som_cell_distance, 6) AS CellDistance, COALESCE(bm.Created, 0) AS "Bookmark Created",
       COALESCE(bm.Comment, '') AS "Bookmark Comment"
FROM r JOIN ev ON ev.ID = r.ID JOIN fin ON fin.ID = r.ID LEFT JOIN bm ON bm.ID = r.ID""")


@oracle("a11_hit_csv")
def _a11():
    return with_ctes(*merged(hits_ctes(FLAGSHIP), som_ctes(), [BOOKMARKS]), body="""SELECT h.ID, round(h.score, 6) AS Score,
       ev.name AS Name, ev.path AS Path, ev.extension AS Extension, ev.size AS Size,
       ev.modified * 1000 AS Modified, ev.accessed * 1000 AS Accessed, ev.created * 1000 AS Created,
       fin.cell AS Cell, round(fin.som_cell_distance, 6) AS CellDistance, CAST(h.s_start AS BIGINT) AS Start,
       CAST(h.s_end AS BIGINT) AS "End", regexp_replace(h.snippet, '[\\r\\n]', ' ', 'g') AS Snippet,
       COALESCE(bm.Created, 0) AS "Bookmark Created", COALESCE(bm.Comment, '') AS "Bookmark Comment"
FROM hits h JOIN ev ON ev.ID = h.ID JOIN fin ON fin.ID = h.ID LEFT JOIN bm ON bm.ID = h.ID""")


_ALLF = ["f_" + f for f in K.HIT_FEATURES]


@oracle("a12_document_features")
def _a12():
    return _hits_sql(f"""SELECT ID, {_r(_ALLF)} FROM (
  SELECT *, row_number() OVER (PARTITION BY ID ORDER BY raw_score DESC, s_idx) AS rn FROM rawh) WHERE rn = 1""")


@oracle("a13_hit_features")
def _a13():
    names = sql_list(list(K.HIT_FEATURES))
    vals = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in _ALLF) + "]"
    return _hits_sql(f"""SELECT ID, start, feature, round(value, 6) AS value FROM (
  SELECT ID, CAST(s_start AS BIGINT) AS start, unnest({names}) AS feature, unnest({vals}) AS value FROM rawh)""")


# ------------------------------------------------------------ H: bookmarks

@oracle("h1_create_bookmark")
def _h1():
    return with_ctes(*flagship_scores(), body="""SELECT 'top five' AS Comment, CAST(1500000000000 AS BIGINT) AS Created, ID
FROM (SELECT ID FROM r ORDER BY score DESC, CAST(ID AS BIGINT) LIMIT 5)""")


@oracle("h2_bookmarks_for_docs")
def _h2():
    return with_ctes(*flagship_scores(), BOOKMARKS, body="""SELECT Comment, Created, ID FROM bm WHERE Comment IN (
  SELECT Comment FROM bm WHERE ID IN (SELECT ID FROM r ORDER BY score DESC, CAST(ID AS BIGINT) LIMIT 20))""")


@oracle("h3_all_bookmarks")
def _h3():
    return with_ctes(EVIDENCE, BOOKMARKS, body="SELECT Comment, Created, ID FROM bm")


@oracle("h3_bookmark_ids")
def _h3_ids():
    return with_ctes(EVIDENCE, BOOKMARKS, body="SELECT 'b' || lpad(substring(Comment, 6), 4, '0') AS Bookmark, Comment, Created, ID FROM bm")


@oracle("h4_comment_search")
def _h4():
    return (f"SELECT conv_id, turn FROM conversations WHERE "
            f"list_has_any(regexp_extract_all(lower(text), {q(TOKEN_RE)}), ['des', 'the'])")


@oracle("h5_bookmark_limit")
def _h5():
    return with_ctes(EVIDENCE, BOOKMARKS, body="""SELECT Comment, Created, ID FROM bm WHERE Created IN (
  SELECT DISTINCT Created FROM bm ORDER BY Created LIMIT 3)""")


@oracle("h6_results_bookmarks")
def _h6():
    return with_ctes(*flagship_scores(), BOOKMARKS, body="""SELECT r.ID, r.score,
       COALESCE(bm.Created, 0) AS bookmark_created, COALESCE(bm.Comment, '') AS bookmark_comment
FROM r LEFT JOIN bm ON bm.ID = r.ID""")


@oracle("h7_hits_bookmarks")
def _h7():
    return with_ctes(*hits_ctes(FLAGSHIP), BOOKMARKS, body="""SELECT h.ID, CAST(h.s_start AS BIGINT) AS start,
       round(h.score, 6) AS score, COALESCE(bm.Created, 0) AS bookmark_created,
       COALESCE(bm.Comment, '') AS bookmark_comment
FROM hits h LEFT JOIN bm ON bm.ID = h.ID""")


@oracle("h8_bookmarked_flag")
def _h8():
    return with_ctes(*flagship_scores(), BOOKMARKS, body="""SELECT p.ID, p.score, p.ID IN (SELECT ID FROM bm) AS bookmarked
FROM (SELECT * FROM r ORDER BY score DESC, CAST(ID AS BIGINT) LIMIT 20) p""")


def _record_bodies() -> str:
    """Texts and tokens of the records' files and slack. Every tenth
    document's last 200 bytes are slack; a character that the cut splits is
    lost on both sides (its bytes become spaces)."""
    def text(x):
        for pattern in (HTML_SCRIPT_RE, HTML_STYLE_RE, HTML_TAG_RE, WHITESPACE_RUN):
            x = f"regexp_replace({x}, {q(pattern)}, ' ', 'g')"
        return x
    plain = "regexp_replace({}, '[\\x00-\\x1f]', '', 'g')"
    return f"""cut AS (SELECT doc_id, doc_id % 8 = 1 AS html, text,
        CASE WHEN doc_id % 10 = 0 AND strlen(text) > 200 THEN strlen(text) - 200 END AS size FROM documents),
kept AS (SELECT doc_id, MAX(k) AS k FROM (SELECT doc_id, text, size, unnest(range(greatest(length(text) - 201, 0), length(text) - 48)) AS k
         FROM cut WHERE size IS NOT NULL) WHERE strlen(substring(text, 1, CAST(k AS BIGINT))) <= size GROUP BY doc_id),
part AS (SELECT doc_id, html, CASE WHEN size IS NULL THEN text ELSE substring(text, 1, CAST(k AS BIGINT)) || ' ' END AS t
         FROM cut LEFT JOIN kept USING (doc_id)
         UNION ALL SELECT doc_id + 1000000000, false, substring(text, CAST(k AS BIGINT)
             + CASE WHEN strlen(substring(text, 1, CAST(k AS BIGINT))) = size THEN 1 ELSE 2 END)
         FROM cut JOIN kept USING (doc_id)),
body AS (SELECT doc_id AS ID, CASE WHEN html THEN {text('t')} ELSE {plain.format('t')} END AS body FROM part),
stops AS (SELECT DISTINCT lower(unnest({STOPS})) AS term),
tok AS (SELECT ID, unnest(regexp_extract_all(lower(body), {q(TOKEN_RE)})) AS term FROM body)"""


@oracle("i1_streaming_ingest")
def _i1():
    """Term statistics of the records' file and slack texts."""
    return with_ctes(_record_bodies(), body="""SELECT term, COUNT(DISTINCT ID) AS df, COUNT(*) AS ttf FROM tok
WHERE term NOT IN (SELECT term FROM stops) GROUP BY term""")


def _described(body: str) -> str:
    """Documents of the described records (slack and unallocated ones without
    a token are dropped), their fields and the tokens that are no stop words."""
    return with_ctes(_record_bodies(), f"""known AS (SELECT ID, term FROM tok WHERE term NOT IN (SELECT term FROM stops)),
slot AS (SELECT ID AS n, ID >= 1000000000 AS slack, CASE WHEN ID >= 1000000000 THEN ID - 1000000000 ELSE ID END AS doc_id FROM body),
rd AS (SELECT n, slack, CAST(doc_id * 2 + CASE WHEN slack THEN 1 ELSE 0 END AS VARCHAR) AS ID, d.*,
         CASE WHEN doc_id % 10 = 0 AND strlen(text) > 200 THEN strlen(text) - 200 ELSE strlen(text) END AS msize,
         md5(text) AS md5, epoch_ms((1300000000 + doc_id * 7200) * 1000) AS acquired
       FROM slot JOIN documents d USING (doc_id)
       WHERE NOT (slack OR doc_id % 5 = 4) OR n IN (SELECT ID FROM known)),
dt AS (SELECT rd.ID, term, COUNT(*) AS tf FROM rd JOIN known k ON k.ID = rd.n GROUP BY ALL),
len AS (SELECT ID, SUM(tf) AS len FROM dt GROUP BY ID),
nd AS (SELECT COUNT(*) AS n FROM rd)""", body=body)


@oracle("b2_field_table")
def _b2_field_table():
    def rows(key, string="NULL", long="NULL", seconds="NULL", keep="true"):
        return (f"SELECT r.ID, '{key}' AS key, CAST({string} AS VARCHAR) AS string, CAST({long} AS BIGINT) AS long, "
                f"CAST({seconds} AS BIGINT) AS seconds FROM rd r JOIN ev e ON e.ID = CAST(r.doc_id * 2 AS VARCHAR) WHERE {keep}")
    parts = [rows("path", "e.path"), rows("name", "e.name || CASE WHEN slack THEN ':slack' ELSE '' END"),
             rows("size", long="CASE WHEN slack THEN 200 ELSE msize END"),
             *[rows(c, long=f"e.{c}", seconds=f"e.{c}") for c in ("modified", "created", "accessed")],
             rows("origin-lang", "lang", keep="lang IS NOT NULL"), rows("origin-corpus", "source", keep="source IS NOT NULL"),
             rows("tags-0", "lang", keep="lang IS NOT NULL"), rows("tags-1", "source", keep="source IS NOT NULL"),
             rows("acquired", "strftime(acquired, '%Y-%m-%dT%H:%M:%SZ')", seconds="epoch(acquired)"),
             rows("count-chars", long="n_chars", keep="n_chars IS NOT NULL"),
             rows("count-words", long="n_chars // 4", keep="n_chars IS NOT NULL"), rows("hash-sums-0-md5", "r.md5")]
    return _described("SELECT * FROM (" + "\nUNION ALL ".join(parts) + ")").replace("WITH cut", f"WITH {EVIDENCE}, cut", 1)


@oracle("d3_metadata_key")
def _d3_metadata_key():
    return _described("""SELECT ID, round((SELECT 1 + ln(n / ((SELECT COUNT(*) FROM rd WHERE lang = 'de') + 1.0)) FROM nd), 6) AS score
FROM rd WHERE lang = 'de'""")


@oracle("d3_list_item")
def _d3_list_item():
    idf = "(SELECT 1 + ln(n / ((SELECT COUNT(*) FROM {}) + 1.0)) FROM nd)"
    f, t = idf.format("rd WHERE source = 'src0'"), idf.format("dt WHERE term = 'from'")
    return _described(f"""SELECT rd.ID, round((pow({f}, 2) + sqrt(tf) * pow({t}, 2) / sqrt(len)) / sqrt(pow({f}, 2) + pow({t}, 2)), 6) AS score
FROM rd JOIN dt ON dt.ID = rd.ID AND term = 'from' JOIN len ON len.ID = rd.ID
WHERE source = 'src0' AND (lang IS NULL OR lang <> 'de')""")


@oracle("d14_string_range")
def _d14_string():
    return _described("SELECT ID FROM rd WHERE md5 >= '3' AND md5 < 'a8'")


@oracle("d14_metadata_number_range")
def _d14_number():
    return _described("SELECT ID FROM rd WHERE n_chars // 4 > 100 AND n_chars // 4 <= 400")


@oracle("d14_date_range")
def _d14_date():
    return _described("SELECT ID FROM rd WHERE acquired >= TIMESTAMP '2011-03-20' AND acquired < TIMESTAMP '2011-04-02 12:00:00'")


@oracle("d14_core_date_range")
def _d14_core_date():
    return _described("SELECT ID FROM rd WHERE epoch_ms((1300086400 + doc_id * 3600) * 1000) >= TIMESTAMP '2011-03-16'")


ORACLE_SQL.update({name: fn() for name, fn in _LATER.items()})
ORACLE_SQL["e4_keyset_page"] = ORACLE_SQL["e4_page"]
ORACLE_SQL["a6_doc_vectors_sink"] = ORACLE_SQL["g3_doc_vectors"]
ORACLE_SQL["a7_assignments_sink"] = ORACLE_SQL["g14_assignments"]
