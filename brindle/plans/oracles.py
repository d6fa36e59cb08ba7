"""DuckDB SQL of the registered queries, on the same tables.

Conditions, texts and names are built from the source columns here, not parsed back, so that the SQL
doesn't repeat what it checks.
"""

from __future__ import annotations

CATALOGUE = """
    cat AS (
        SELECT p_partkey, 'PN' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '-' || CAST(p_size AS VARCHAR) AS part,
               CASE WHEN p_partkey % 5 = 0 THEN 'P' WHEN p_partkey % 5 <> 1 THEN 'N' END AS channel,
               CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN -CAST(p_size AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS vds,
               p_brand, p_type FROM part),
    eff AS (SELECT *, coalesce(channel, CASE WHEN vds < 0 THEN 'P' WHEN vds IS NOT NULL THEN 'N' END) AS ch FROM cat),
    rd AS (
        SELECT part, ch, vds, 'Tj = ' || CASE WHEN l_linestatus = 'O' THEN '25' ELSE '100' END || ' °C; VGS = ' ||
               CASE l_returnflag WHEN 'R' THEN '10' WHEN 'A' THEN '4.5' ELSE '5' END || ' V' AS cls, floor(l_extendedprice) AS v
        FROM lineitem JOIN eff ON l_partkey = p_partkey),
    idm AS (
        SELECT part, ch, vds, CASE WHEN l_linenumber % 2 = 1 THEN 'Tamb' ELSE 'Tmb' END || ' = 25 °C; VGS = 10 V' ||
               CASE WHEN l_tax > 0.06 THEN '; t <= 5 s' ELSE '' END AS cls, l_quantity AS v
        FROM lineitem JOIN eff ON l_partkey = p_partkey)"""


def _count(where: str) -> str:
    return f"""WITH {CATALOGUE} SELECT 'count' AS kind, CAST(NULL AS VARCHAR) AS cond_class, CAST(count(*) AS DOUBLE) AS value,
        CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS VARCHAR) AS parts, count(*) AS candidates FROM eff WHERE {where}"""


def _extremum(source: str, op: str, unit: str, where: str, kind: str, label: str = "per.cls") -> str:
    return f"""WITH {CATALOGUE},
        per AS (SELECT cls, part, {op}(v) AS v FROM {source} WHERE {where} GROUP BY cls, part),
        best AS (SELECT cls, {op}(v) AS best, count(*) AS candidates FROM per GROUP BY cls)
        SELECT '{kind}' AS kind, {label} AS cond_class, best AS value, '{unit}' AS unit,
               string_agg(part, ',' ORDER BY part) AS parts, candidates
        FROM per JOIN best ON per.cls IS NOT DISTINCT FROM best.cls AND v = best GROUP BY per.cls, best, candidates"""


_RAG = """
    q AS (SELECT vec_id AS qid, embedding AS qv, CAST(label AS VARCHAR) AS gold,
                 CASE WHEN vec_id % 40 = 0 THEN CAST(label AS VARCHAR) END AS symbol FROM embeddings WHERE vec_id % 20 = 0),
    c AS (SELECT vec_id, CAST(label AS VARCHAR) || '#' || CAST(vec_id AS VARCHAR) AS chunk_id, CAST(label AS VARCHAR) AS document_id, embedding AS cv
          FROM embeddings WHERE label NOT IN (3, 7)),
    sims AS (SELECT qid, symbol, chunk_id, document_id, list_cosine_similarity(qv::DOUBLE[], cv::DOUBLE[]) AS score FROM q JOIN c ON vec_id <> qid),
    dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sims QUALIFY rank <= 10),
    inside AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sims WHERE symbol = document_id QUALIFY rank <= 10),
    docs AS (SELECT qid, document_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM dense GROUP BY qid, document_id),
    sdocs AS (SELECT qid, document_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM inside GROUP BY qid, document_id),
    reranked AS (SELECT d.qid, d.document_id, row_number() OVER (PARTITION BY d.qid ORDER BY (q.symbol IS NOT DISTINCT FROM d.document_id) DESC, d.rank) AS rank
                 FROM docs d JOIN q ON d.qid = q.qid),
    parts AS (SELECT qid, document_id, 1.0::DOUBLE / (60 + rank) AS p, 0 AS l, rank AS r FROM docs
              UNION ALL SELECT qid, document_id, 2.0::DOUBLE / (60 + rank), 1, rank FROM sdocs),
    fused AS (SELECT qid, document_id, sum(p) AS score, min(l * 100000 + r) AS seen FROM parts GROUP BY qid, document_id),
    franked AS (SELECT qid, document_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS rank FROM fused)"""


def _metrics(source: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}," if by else ""
    hit = "CASE WHEN rank BETWEEN 1 AND {k} THEN {v} ELSE 0.0::DOUBLE END"
    at = lambda k, v, name: f"round(avg({hit.format(k=k, v=v)}), 4) AS {name}"
    columns = [at(k, "1.0::DOUBLE", f"recall_{k}") for k in (1, 3, 5, 10)]
    columns += ["round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END), 4) AS mrr"]
    columns += [at(k, "1.0::DOUBLE / log2(rank + 1.0)", f"ndcg_{k}") for k in (5, 10)]
    return f"SELECT {lead} count(*) AS questions, {', '.join(columns)} FROM {source} {group}"


def _gold(name: str, ranked: str) -> str:
    return f"""SELECT '{name}' AS strategy, q.qid, coalesce(min(r.rank), 0) AS rank FROM q LEFT JOIN {ranked} r
        ON q.qid = r.qid AND q.gold = r.document_id GROUP BY q.qid"""


_STRATEGIES = f"{_RAG}, ranks AS ({_gold('dense', 'docs')} UNION ALL {_gold('dense+symbol', 'reranked')} UNION ALL {_gold('hybrid-rrf', 'franked')})"

_ANSWERS = """
    a AS (SELECT o_orderkey AS qid, o_orderpriority AS dimension, floor(o_totalprice) AS printed, o_orderkey % 13 = 0 AS refused, o_orderkey % 4 = 0 AS holdout,
                 CASE WHEN o_orderkey % 7 = 0 THEN floor(o_totalprice) * 2 + 10 WHEN o_orderkey % 7 = 1 THEN -floor(o_totalprice) ELSE floor(o_totalprice) END AS value,
                 o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AS has FROM orders),
    m AS (SELECT *, CASE WHEN has THEN printed END AS found, has AND abs(abs(printed) - abs(value)) <= greatest(abs(value) * 0.01, 1e-9) AS ok FROM a),
    g AS (SELECT *, CASE WHEN has AND value <> 0 THEN sign(printed) = sign(value) END AS signed,
                 CASE WHEN refused AND holdout THEN 'refused-correctly' WHEN refused THEN 'refused-wrongly' WHEN holdout THEN 'hallucinated'
                      WHEN ok THEN 'match' WHEN found IS NULL THEN 'no-value' ELSE 'wrong-value' END AS reason FROM m)"""

_QUESTIONS = "qs AS (SELECT p_partkey, 'PN' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '-' || CAST(p_size AS VARCHAR) AS part FROM part)"
_NAMED = "CASE p_partkey % 3 WHEN 0 THEN [] WHEN 1 THEN [part, 'BUK7K5R1-30E'] ELSE [part] END"

_INDEX = """
    idx AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id AS key, doc_id % 5 + 1 AS total, unnest(range(0, doc_id % 5 + 1)) AS index FROM documents)"""

_TABLE = """
    t AS (SELECT l_orderkey AS part, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey AS pos, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS max,
                 CASE WHEN l_returnflag = 'R' THEN '10' ELSE '4.5' END AS volts, CASE WHEN l_linestatus = 'O' THEN '25' ELSE '100' END AS heat
          FROM lineitem WHERE l_linenumber % 3 <> 0
          QUALIFY row_number() OVER (PARTITION BY l_orderkey, volts, heat, max ORDER BY pos) = 1)"""

ORACLES: dict[str, str] = {
    "catalog_count_package": _count("lower(p_brand) = 'brand#23' OR lower(p_type) = 'brand#23'"),
    "catalog_count_vds": _count("abs(vds) = 30"),
    "catalog_count_channel": _count("ch = 'P'"),
    "catalog_min_rdson_class": _extremum("rd", "min", "mΩ", "ch = 'N' AND cls = 'Tj = 25 °C; VGS = 10 V'", "extremum", "'tj = 25 °C; vgs = 10 v'"),
    "catalog_max_id_class": _extremum("idm", "max", "A", "cls = 'Tmb = 25 °C; VGS = 10 V'", "extremum"),
    "catalog_ambiguous_rdson": _extremum("rd", "min", "mΩ", "true", "ambiguous-conditions"),
    "catalog_ambiguous_id": _extremum("idm", "max", "A", "ch = 'P'", "ambiguous-conditions"),
    "catalog_empty": "SELECT 'empty' AS kind, CAST(NULL AS VARCHAR) AS cond_class, CAST(NULL AS DOUBLE) AS value, 'mΩ' AS unit, CAST(NULL AS VARCHAR) AS parts, CAST(0 AS BIGINT) AS candidates",
    "catalog_extremum_vds": f"""WITH {CATALOGUE}, v AS (SELECT part, abs(vds) AS v FROM eff WHERE ch = 'P' AND vds IS NOT NULL)
        SELECT 'extremum' AS kind, CAST(NULL AS VARCHAR) AS cond_class, max(v) AS value, 'V' AS unit,
               (SELECT string_agg(part, ',' ORDER BY part) FROM v WHERE v = (SELECT max(v) FROM v)) AS parts, count(*) AS candidates FROM v""",
    "batch_set_questions": f"""WITH {CATALOGUE},
        s AS (SELECT event_id AS qid, CASE event_id % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'min' ELSE 'max' END AS op,
                     CASE WHEN event_id % 4 <> 0 THEN ['rdson', 'id', 'vds'][user_id % 3 + 1] END AS field, CASE event_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'P' END AS ch,
                     CASE WHEN event_id % 7 <> 0 THEN user_id % 8 * 5 + 1 END AS vds, CASE WHEN user_id % 4 = 0 THEN 'brand#' || (user_id % 5 + 1) || (user_id % 5 + 1) END AS pk,
                     CASE WHEN event_id % 4 <> 0 AND user_id % 3 <> 2 THEN CASE event_id % 5 WHEN 0 THEN 'Tj = 25 °C; VGS = 10 V' WHEN 1 THEN 'Tmb = 25 °C; VGS = 10 V' END END AS asked FROM events),
        d AS (SELECT *, row_number() OVER () AS k FROM (SELECT DISTINCT op, field, ch, vds, pk, asked FROM s)),
        f AS (SELECT 'rdson' AS field, part, cls, v FROM rd UNION ALL SELECT 'id', part, cls, v FROM idm UNION ALL SELECT 'vds', part, NULL, abs(vds) FROM eff WHERE vds IS NOT NULL
              UNION ALL SELECT 'count', part, NULL, 0 FROM eff),
        fits AS (SELECT k, op, d.field, asked, part FROM d JOIN eff e ON (d.ch IS NULL OR e.ch = d.ch) AND (d.vds IS NULL OR abs(e.vds) = d.vds) AND (pk IS NULL OR lower(p_brand) = pk OR lower(p_type) = pk)),
        per AS (SELECT k, op, coalesce(asked, cls) AS c, f.part, CASE op WHEN 'min' THEN min(v) ELSE max(v) END AS v
                FROM fits JOIN f ON f.part = fits.part AND f.field = coalesce(fits.field, 'count') WHERE asked IS NULL OR cls = asked GROUP BY k, op, coalesce(asked, cls), f.part),
        best AS (SELECT k, c, CASE op WHEN 'min' THEN min(v) ELSE max(v) END AS best, count(*) AS n FROM per GROUP BY k, op, c),
        g AS (SELECT k, per.c, best, n, count(*) AS n_parts, min(part) AS first_part, count(*) OVER (PARTITION BY k) AS classes
              FROM per JOIN best USING (k) WHERE per.c IS NOT DISTINCT FROM best.c AND v = best GROUP BY k, per.c, best, n)
        SELECT qid, CASE WHEN s.op = 'count' THEN 'count' WHEN classes > 1 THEN 'ambiguous-conditions' WHEN classes = 1 THEN 'extremum' ELSE 'empty' END AS kind, g.c AS cond_class,
               CASE WHEN s.op = 'count' THEN CAST(coalesce(n, 0) AS DOUBLE) ELSE best END AS value, CASE s.field WHEN 'rdson' THEN 'mΩ' WHEN 'id' THEN 'A' WHEN 'vds' THEN 'V' END AS unit,
               CASE WHEN s.op <> 'count' THEN CAST(coalesce(n_parts, 0) AS INTEGER) ELSE 0 END AS n_parts, CASE WHEN s.op <> 'count' THEN first_part END AS first_part, coalesce(n, 0) AS candidates
        FROM s JOIN d ON s.op = d.op AND s.field IS NOT DISTINCT FROM d.field AND s.ch IS NOT DISTINCT FROM d.ch AND s.vds IS NOT DISTINCT FROM d.vds
                      AND s.pk IS NOT DISTINCT FROM d.pk AND s.asked IS NOT DISTINCT FROM d.asked LEFT JOIN g USING (k)""",
    "catalog_explain": f"""WITH {CATALOGUE}, per AS (SELECT part, min(v) AS v FROM rd WHERE ch = 'N' AND cls = 'Tj = 25 °C; VGS = 10 V' GROUP BY part),
        w AS (SELECT list(part ORDER BY part) AS parts FROM per WHERE v = (SELECT min(v) FROM per))
        SELECT 'Of the ' || (SELECT count(*) FROM per) || ' parts in this corpus, specified at Tj = 25 °C; VGS = 10 V, the lowest R_DS(on) is ' ||
               CAST(CAST((SELECT min(v) FROM per) AS BIGINT) AS VARCHAR) || ' mΩ: ' ||
               CASE WHEN len(parts) = 1 THEN parts[1] ELSE array_to_string(parts[:-2], ', ') || ' and ' || parts[-1] END || '.' AS sentence FROM w""",
    "catalog_pool": f"WITH {CATALOGUE} SELECT DISTINCT part FROM rd WHERE ch = 'N' AND cls = 'Tj = 25 °C; VGS = 10 V'",
    "catalog_vocabulary": f"""WITH {CATALOGUE}
        SELECT DISTINCT 'package' AS kind, p_brand AS term FROM eff UNION SELECT 'package', p_type FROM eff
        UNION SELECT 'rating', CAST(CAST(abs(vds) AS BIGINT) AS VARCHAR) FROM eff WHERE vds IS NOT NULL
        UNION SELECT 'rdson_class', cls FROM rd UNION SELECT 'id_class', cls FROM idm""",
    "conservative_dedupe": """WITH m AS (SELECT l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN 'Tamb' ELSE 'Tmb' END || ' = 25 °C; VGS = 10 V' || CASE WHEN l_tax > 0.06 THEN '; t <= 5 s' ELSE '' END AS cond_class,
            CASE WHEN l_orderkey % 2 = 0 THEN -l_quantity ELSE l_quantity END AS value, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)
        SELECT l_partkey, cond_class, value FROM m QUALIFY row_number() OVER (PARTITION BY l_partkey, cond_class ORDER BY abs(value) DESC, pos) = 1""",
    "condition_class_histogram": f"WITH {CATALOGUE} SELECT cls AS cond_class, count(*) AS n FROM rd GROUP BY cls",
    "clean_packages": """SELECT p_partkey, concat_ws('|', 'LFPAK' || p_size, 'Power-SO8', 'SOT' || lpad(CAST(p_partkey AS VARCHAR), 6, '1') || '-2', 'SOT' || lpad(CAST(p_partkey AS VARCHAR), 6, '1'), 'to247') AS names FROM part""",
    "fnv_split": f"""WITH {_QUESTIONS}, h AS (SELECT part, list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(part, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM qs)
        SELECT part, CAST(h AS BIGINT) AS hash, h % 100 < 28 AS holdout FROM h""",
    "decode_name": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST('5.' || p_size AS DOUBLE) WHEN 1 THEN CAST('0.' || p_size AS DOUBLE) WHEN 2 THEN CAST(p_size AS DOUBLE) END AS rdson_mohm,
        CASE p_partkey % 4 WHEN 0 THEN 40.0::DOUBLE WHEN 1 THEN 80.0::DOUBLE WHEN 2 THEN 100.0::DOUBLE END AS vds_v FROM part""",
    "identifiers_in_text": f"""WITH {_QUESTIONS} SELECT p_partkey, array_to_string({_NAMED}, '|') AS named,
        CASE p_partkey % 3 WHEN 1 THEN 'BUK7K5R1-30E' ELSE '' END AS numbers FROM qs""",
    "guard_refusals": f"""WITH {_QUESTIONS}, n AS (SELECT {_NAMED} AS named, CASE WHEN p_partkey % 2 = 0 THEN part ELSE 'PN00000-0' END AS got FROM qs)
        SELECT len(named) > 0 AND NOT list_contains(named, got) AS refused, count(*) AS n FROM n GROUP BY 1""",
    "vocabulary_names": f"""WITH {_QUESTIONS} SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'X' || part || '|AB1' ELSE part || '|X' || part || '|AB1' END AS named FROM qs""",
    "route_questions": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'set' ELSE 'document' END AS route FROM part",
    "measures_roundtrip": """SELECT o_orderkey, round(CASE o_orderkey % 5 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN floor(o_totalprice) * 1000 WHEN 2 THEN floor(o_totalprice) / 1000
            WHEN 3 THEN floor(o_totalprice) * 1000 ELSE floor(o_totalprice) END, 6) AS value,
        CASE o_orderkey % 5 WHEN 0 THEN 'V' WHEN 1 THEN 'V' WHEN 2 THEN 'A' ELSE 'mΩ' END AS unit, CAST(1 AS BIGINT) AS n FROM orders""",
    "grade_answers": f"WITH {_ANSWERS} SELECT qid, found, signed, reason FROM g",
    "grade_reason_histogram": f"WITH {_ANSWERS} SELECT reason, count(*) AS n FROM g GROUP BY reason",
    "rates_by_dimension": f"""WITH {_ANSWERS} SELECT dimension, count(*) AS n, round(avg(CASE WHEN reason IN ('match', 'refused-correctly') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate,
        round(avg(CAST(signed AS INTEGER)), 6) AS sign_agreement FROM g GROUP BY dimension""",
    "precision_coverage": f"""WITH {_ANSWERS} SELECT round(count(*) FILTER (reason = 'match') / count(*) FILTER (reason IN ('match', 'wrong-value')), 6) AS precision,
        round(count(*) FILTER (reason IN ('match', 'wrong-value')) / count(*) FILTER (reason <> 'refused-wrongly'), 6) AS coverage, count(*) AS n FROM g WHERE NOT holdout""",
    "outcome_summary": """SELECT CASE WHEN doc_id % 11 = 0 THEN 'catalog-empty' WHEN doc_id % 7 = 0 THEN 'guard-refused' WHEN toxic = 1 THEN 'model-refused'
            WHEN doc_id % 5 = 0 AND lang = 'en' THEN 'hedged' WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n, count(DISTINCT lang) AS langs
        FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "dense_topk": f"WITH {_RAG} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM dense",
    "search_within": f"WITH {_RAG} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM inside",
    "rank_documents": f"WITH {_RAG} SELECT qid, document_id, rank FROM docs",
    "rerank_symbol": f"WITH {_RAG} SELECT qid, document_id, rank FROM reranked",
    "rrf_fusion": f"WITH {_RAG} SELECT qid, document_id, round(score, 9) AS score, rank FROM franked",
    "evidence_chunks": f"""WITH {_RAG}, hits AS (SELECT qid, chunk_id, document_id, 0 AS src, -score AS key, rank AS pos FROM inside
            UNION ALL SELECT qid, chunk_id, document_id, 1, rank, rank FROM dense),
        firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY src, key, pos) = 1)
        SELECT qid, chunk_id, document_id, row_number() OVER (PARTITION BY qid ORDER BY src, key, pos, chunk_id) AS rank FROM firsts QUALIFY rank <= 10""",
    "citations": f"WITH {_RAG} SELECT qid, document_id, rank FROM docs WHERE rank <= 3",
    "retrieval_metrics": f"WITH {_STRATEGIES} {_metrics('(SELECT * FROM ranks WHERE strategy = ' + chr(39) + 'dense' + chr(39) + ')')}",
    "strategy_ablation": f"WITH {_STRATEGIES} {_metrics('ranks', 'strategy')}",
    "best_strategy": f"WITH {_STRATEGIES}, m AS ({_metrics('ranks', 'strategy')}) SELECT strategy, mrr FROM m ORDER BY mrr DESC, CASE strategy WHEN 'dense' THEN 1 WHEN 'dense+symbol' THEN 2 ELSE 3 END LIMIT 1",
    "strip_lines": "SELECT doc_id AS id, CAST(length(text) AS BIGINT) AS n, sha256(text) AS digest FROM documents",
    "bind_symbols": """WITH l AS (SELECT conv_id AS id, turn AS pos, turn % 3 = 0 AS opens, turn % 3 = 1 AND conv_id % 2 = 0 AS blank FROM conversations),
        e AS (SELECT *, last_value(CASE WHEN opens THEN 1 WHEN blank THEN 0 END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM l)
        SELECT id, pos, CASE WHEN opens THEN 'VDS   drain-source voltage   Tj = 25 °C   -   30   V' WHEN blank THEN ''
            ELSE CASE WHEN held = 1 THEN '  VDS   drain-source voltage   ' ELSE '  ' END || 'Tj = ' || pos || ' °C   -   25   V' END AS line FROM e""",
    "degenerate_texts": """WITH w AS (SELECT conv_id, turn, role, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations),
        c AS (SELECT conv_id, turn, role, w, count(*) AS n FROM w GROUP BY ALL),
        d AS (SELECT conv_id, turn, role, sum(n) >= 12 AND max(n) / sum(n) > 0.3 AS bad FROM c GROUP BY ALL)
        SELECT 'conversations' AS source, role AS kind, count(*) AS n, count(*) FILTER (coalesce(bad, false)) AS degenerate FROM conversations LEFT JOIN d USING (conv_id, turn, role) GROUP BY role
        UNION ALL SELECT 'documents', lang, count(*), count(*) FILTER (coalesce(len(w) >= 12 AND list_max(map_values(list_histogram(w))) / len(w) > 0.3, false))
        FROM (SELECT lang, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents) GROUP BY lang""",
    "ingest_replace": f"""WITH {_INDEX} SELECT document_id || '#' || index AS id, document_id, CASE WHEN key % 3 = 0 THEN 2 ELSE 1 END AS version
        FROM idx WHERE key % 3 <> 0 OR index < 2""",
    "ingest_settled": f"""WITH {_INDEX} SELECT document_id || '#' || index AS id, document_id,
            CASE WHEN key % 6 = 0 AND index = 3 THEN '3' WHEN key % 3 = 0 THEN '2' ELSE '1' END AS version
        FROM idx WHERE key % 3 <> 0 OR index < 2 OR (key % 6 = 0 AND index = 3)""",
    "stale_ids": f"""WITH {_INDEX}, s AS (SELECT DISTINCT document_id, document_id || '#' || unnest(range(total, total + 80)) AS id FROM idx)
        SELECT document_id, min(id) AS first, count(*) AS n FROM s GROUP BY document_id""",
    "set_questions": f"""WITH {CATALOGUE},
        sup AS (SELECT 'min-rdson' AS kind, 'mΩ' AS unit, channel || '|' || CAST(CAST(abs(r.vds) AS BIGINT) AS VARCHAR) || '|' || cls AS key, r.part, -max(v) AS score FROM rd r JOIN cat USING (part) WHERE r.vds IS NOT NULL AND channel IS NOT NULL GROUP BY ALL
            UNION ALL SELECT 'max-id', 'A', channel || '|' || CAST(CAST(abs(r.vds) AS BIGINT) AS VARCHAR) || '|' || cls, r.part, max(v) FROM idm r JOIN cat USING (part) WHERE r.vds IS NOT NULL AND channel IS NOT NULL GROUP BY ALL),
        best AS (SELECT kind, unit, key, max(score) AS best, count(*) AS candidates FROM sup GROUP BY ALL HAVING count(*) >= 4),
        names AS (SELECT part, p_brand AS key FROM cat UNION SELECT part, p_type FROM cat)
        SELECT 'corpus:' || b.kind || ':' || b.key AS id, b.kind AS kind, string_agg(part, ',' ORDER BY part) AS parts, abs(best) AS truth_value, b.unit AS unit, candidates
        FROM best b JOIN sup s ON s.kind = b.kind AND s.key = b.key AND s.score = b.best GROUP BY ALL
        UNION ALL SELECT 'corpus:count-package:' || key, 'count-package', '', CAST(count(*) AS DOUBLE), NULL, count(*) FROM names GROUP BY key HAVING count(*) >= 4
        UNION ALL SELECT 'corpus:count-vds:' || CAST(CAST(abs(vds) AS BIGINT) AS VARCHAR), 'count-vds', '', CAST(count(*) AS DOUBLE), NULL, count(*) FROM cat WHERE vds IS NOT NULL GROUP BY abs(vds) HAVING count(*) >= 4""",
    "table_rows": f"WITH {_TABLE} SELECT part, pos, max, 'mΩ' AS unit FROM t",
    "label_pick": f"""WITH {_TABLE} SELECT part, pos, CAST(max AS DOUBLE) AS value, 'VGS = ' || volts || ' V; Tj = ' || heat || ' °C' AS conditions FROM t
        QUALIFY row_number() OVER (PARTITION BY part ORDER BY (heat = '25' AND volts = '10') DESC, heat = '25' DESC, CASE WHEN heat = '25' THEN CAST(volts AS DOUBLE) ELSE 0 END DESC, pos) = 1""",
    "agreement_by_field": f"""WITH {CATALOGUE}
        SELECT 'vds' AS field, count(*) AS n, round(avg(CASE WHEN abs(vds) = abs(CASE WHEN p_partkey % 9 = 0 THEN vds + 1 ELSE abs(vds) END) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS rate FROM cat WHERE vds IS NOT NULL
        UNION ALL SELECT 'channel', count(*), round(avg(CASE WHEN channel = coalesce(channel, 'N') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) FROM cat WHERE p_partkey % 6 <> 0
        UNION ALL SELECT 'package', count(*), round(avg(CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 4) FROM cat""",
    "package_audit": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'SOT669' ELSE '' END AS fabricated, 'LFPAK56' AS missed_by_label,
        CASE WHEN p_partkey % 3 = 0 THEN 'LFPAK56' ELSE '' END AS missed_by_catalogue, true AS all_of_label FROM part""",
    "latency_percentiles": """WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
        SELECT event_type, CAST(len(v) AS BIGINT) AS n, v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95 FROM l""",
    "stride_sample": """WITH o AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events)
        SELECT event_id, user_id FROM o WHERE i IN (SELECT k * n // 100 FROM (SELECT unnest(range(0, 100)) AS k), (SELECT count(*) AS n FROM events))""",
    "index_sizes_curve": f"""WITH {_INDEX}, d AS (SELECT key, count(*) AS n, row_number() OVER (ORDER BY key) AS i FROM idx GROUP BY key),
        s AS (SELECT 's' AS size, count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks FROM d WHERE i <= 5 UNION ALL SELECT 'm', count(*), CAST(sum(n) AS BIGINT) FROM d WHERE i <= 100 UNION ALL SELECT 'l', count(*), CAST(sum(n) AS BIGINT) FROM d)
        SELECT *, chunks * 1024 AS stored_dims, round(greatest(0.0::DOUBLE, chunks * 1024 - 10000000.0::DOUBLE) / 100000000.0::DOUBLE * 0.05, 4) AS cost FROM s""",
    "recall_by_size": f"""WITH {_RAG}, per AS (SELECT document_id, count(*) AS n, row_number() OVER (ORDER BY document_id) AS i FROM c GROUP BY document_id),
        held AS (SELECT size, document_id, n FROM per JOIN (VALUES ('s', 2), ('m', 5), ('l', 1000000000)) z(size, most) ON i <= most),
        asks AS (SELECT size, qid, gold FROM q JOIN held ON gold = document_id),
        near AS (SELECT size, qid, symbol, chunk_id, document_id, score FROM sims JOIN held USING (document_id) JOIN asks USING (size, qid)),
        d10 AS (SELECT *, row_number() OVER (PARTITION BY size, qid ORDER BY score DESC, chunk_id) AS rank FROM near QUALIFY rank <= 10),
        s10 AS (SELECT *, row_number() OVER (PARTITION BY size, qid ORDER BY score DESC, chunk_id) AS rank FROM near WHERE symbol = document_id QUALIFY rank <= 10),
        dd AS (SELECT size, qid, document_id, row_number() OVER (PARTITION BY size, qid ORDER BY min(rank)) AS rank FROM d10 GROUP BY size, qid, document_id),
        ss AS (SELECT size, qid, document_id, row_number() OVER (PARTITION BY size, qid ORDER BY min(rank)) AS rank FROM s10 GROUP BY size, qid, document_id),
        both_lists AS (SELECT size, qid, document_id, 1.0::DOUBLE / (60 + rank) AS p, rank AS seen FROM dd UNION ALL SELECT size, qid, document_id, 2.0::DOUBLE / (60 + rank), 100000 + rank FROM ss),
        ff AS (SELECT size, qid, document_id, row_number() OVER (PARTITION BY size, qid ORDER BY round(sum(p), 12) DESC, min(seen)) AS rank FROM both_lists GROUP BY size, qid, document_id),
        hits AS (SELECT a.size, a.qid, coalesce(min(dd.rank), 0) AS dr, coalesce(min(ff.rank), 0) AS fr FROM asks a
                 LEFT JOIN dd ON dd.size = a.size AND dd.qid = a.qid AND dd.document_id = a.gold LEFT JOIN ff ON ff.size = a.size AND ff.qid = a.qid AND ff.document_id = a.gold GROUP BY a.size, a.qid),
        scores AS (SELECT size, count(*) AS questions, {', '.join(f"round(avg(CASE WHEN {r} BETWEEN 1 AND {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS {n}_recall_{k}" for n, r in (('dense', 'dr'), ('fused', 'fr')) for k in (1, 5))},
                   {', '.join(f"round(avg(CASE WHEN {r} > 0 THEN 1.0::DOUBLE / {r} ELSE 0.0::DOUBLE END), 4) AS {n}_mrr" for n, r in (('dense', 'dr'), ('fused', 'fr')))} FROM hits GROUP BY size),
        sizes AS (SELECT size, count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks FROM held GROUP BY size)
        SELECT *, chunks * 1024 AS stored_dims, round(greatest(0.0::DOUBLE, chunks * 1024 - 10000000.0::DOUBLE) / 100000000.0::DOUBLE * 0.05, 4) AS cost FROM sizes JOIN scores USING (size)""",
    "index_stats": "SELECT count(*) AS vectors, CAST(max(len(embedding)) AS BIGINT) AS dims FROM embeddings",
    "parse_plan": """SELECT event_id AS id, CASE event_id % 5 WHEN 1 THEN 'catalog' WHEN 2 THEN 'lookup' WHEN 4 THEN 'catalog' ELSE 'unsupported' END AS route,
        CASE event_id % 5 WHEN 1 THEN 'min' WHEN 4 THEN 'count' END AS op, CASE event_id % 5 WHEN 1 THEN 'rdson' END AS field,
        CASE event_id % 5 WHEN 1 THEN CAST(event_id % 60 AS DOUBLE) END AS vds, CASE event_id % 5 WHEN 4 THEN 'SO8' END AS package FROM events""",
    "parse_attributes": """SELECT p_partkey AS part, p_partkey % 4 <> 0 AS readable, CASE WHEN p_partkey % 4 >= 2 THEN 'N' END AS channel,
        CASE WHEN p_partkey % 4 >= 2 THEN CAST(p_size AS DOUBLE) END AS vds, CAST(CASE WHEN p_partkey % 4 >= 2 THEN 1 ELSE 0 END AS BIGINT) AS n_rdson,
        CAST(CASE WHEN p_partkey % 4 >= 2 THEN 2 ELSE 0 END AS BIGINT) AS n_id, CASE WHEN p_partkey % 4 >= 2 THEN 'VGS = 10 V' ELSE '' END AS conditions,
        CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'A1' ELSE 'SO8' END AS package FROM part""",
    "fetch_status": """SELECT CASE WHEN page_id % 7 = 0 THEN 'ok' WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 3 <> 0 THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM pages GROUP BY 1""",
    "readable_documents": "SELECT doc_id AS part FROM documents WHERE length(trim(text)) >= 500",
    "batches": """SELECT i // 64 AS batch, min(event_id) AS first, count(*) AS n FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1""",
    "vocabulary_tally": "SELECT name, count(*) AS n FROM (SELECT p_brand AS name FROM part UNION ALL SELECT p_type FROM part) GROUP BY name",
    "name_mentions": """SELECT name, count(*) AS n FROM documents, (VALUES ('of'), ('los'), ('der'), ('que')) AS v(name)
        WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || name || '($|[^A-Za-z0-9])') GROUP BY name""",
}

_LABELS = f"""{_QUESTIONS}, lab AS (SELECT p_partkey, part, vds, channel, p_brand, p_type, h % 100 < 28 AS held FROM cat
        JOIN (SELECT part, list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(part, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM qs) USING (part)),
    pq AS (
        SELECT part, held, 'vds' AS dimension, 'What is the drain-source voltage rating of ' || part || '?' AS question, vds AS value, 'V' AS unit, CAST(NULL AS VARCHAR) AS names FROM lab WHERE vds IS NOT NULL
        UNION ALL SELECT part, held, 'rdson', 'What is the on-state resistance of ' || part || ' at VGS = 10 V; Tj = 25 °C?', CAST(p_partkey % 90 AS DOUBLE), 'mΩ', NULL FROM lab WHERE p_partkey % 7 <> 0
        UNION ALL SELECT part, held, 'id', 'What is the drain current of ' || part || '?', CAST(p_partkey % 40 AS DOUBLE), 'A', NULL FROM lab WHERE p_partkey % 3 <> 0
        UNION ALL SELECT part, held, 'package', 'What is the package of ' || part || '?', NULL, NULL, p_brand || '|' || p_type FROM lab WHERE p_partkey % 2 = 0)"""

_CASES = """
    l AS (SELECT l_orderkey, list(DISTINCT CAST(l_partkey AS VARCHAR)) AS got FROM lineitem GROUP BY 1),
    c AS (SELECT o_orderkey AS k, o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 AS saw_winner,
                 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 6 <> 0 AND o_orderkey % 2 = 0 END AS winner_in_pool, o_orderkey % 3 <> 0 AS wrong
          FROM orders JOIN l ON o_orderkey = l_orderkey)"""


_NUMBER = "CASE WHEN {0} = trunc({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_AGREEMENT = f"""
    lab AS (SELECT *, CASE p_partkey % 9 WHEN 0 THEN vds + 1 WHEN 1 THEN vds * 1.005::DOUBLE WHEN 2 THEN -vds ELSE vds END AS lv FROM cat WHERE p_partkey % 10 <> 0),
    has AS (SELECT part, bool_or(cls = 'Tj = 25 °C; VGS = 10 V') AS c, list(v) FILTER (cls = 'Tj = 25 °C; VGS = 10 V') AS vs FROM rd GROUP BY part),
    ids AS (SELECT part, bool_or(cls = 'Tmb = 25 °C; VGS = 10 V') AS c, list(v) FILTER (cls = 'Tmb = 25 °C; VGS = 10 V') AS vs FROM idm GROUP BY part),
    j AS (SELECT lab.*, coalesce(has.c, false) AS rc, coalesce(ids.c, false) AS ic,
                 coalesce(len(list_filter(has.vs, lambda v: abs(v - p_partkey % 90) <= greatest(p_partkey % 90 * 0.01, 1e-9))) > 0, false) AS rv,
                 coalesce(len(list_filter(ids.vs, lambda v: abs(v - p_partkey % 40) <= greatest(p_partkey % 40 * 0.01, 1e-9))) > 0, false) AS iv
          FROM lab LEFT JOIN has USING (part) LEFT JOIN ids USING (part)),
    f AS (SELECT part, 'vds' AS field, abs(vds - lv) <= abs(lv) * 0.01::DOUBLE AS agrees, {_NUMBER.format("lv")} AS label FROM j WHERE lv IS NOT NULL
          UNION ALL SELECT part, 'rdson_conditions', rc, 'Tj = 25 °C; VGS = 10 V' FROM j WHERE p_partkey % 7 <> 0 UNION ALL SELECT part, 'rdson', rv, p_partkey % 90 || ' @ VGS = 10 V; Tj = 25 °C' FROM j WHERE p_partkey % 7 <> 0
          UNION ALL SELECT part, 'id_conditions', ic, 'Tmb = 25 °C; VGS = 10 V' FROM j WHERE p_partkey % 3 <> 0 UNION ALL SELECT part, 'id', iv, p_partkey % 40 || ' @ VGS = 10 V; Tmb = 25 °C' FROM j WHERE p_partkey % 3 <> 0
          UNION ALL SELECT part, 'package', p_partkey % 8 <> 0, p_brand || CASE WHEN p_partkey % 8 = 0 THEN '|XY1' ELSE '' END FROM j WHERE p_partkey % 2 = 0)"""


def _share(passes: str, among: str) -> str:
    return f"coalesce(round(avg(CASE WHEN {among} THEN CASE WHEN {passes} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 4), 0.0::DOUBLE)"


ORACLES |= {
    "json_scan": f"WITH {CATALOGUE} SELECT part, channel, vds, p_brand || '|' || p_type AS package FROM cat",
    "line_scan": f"WITH {CATALOGUE} SELECT part AS id FROM cat",
    "id_scan": "SELECT DISTINCT unnest(['PSMN' || p_partkey % 50 || 'R0-30YLD', 'BUK' || (p_partkey % 50 + 100) || '-40E']) AS part FROM part",
    "text_readings": """WITH d AS (SELECT lang, text, regexp_replace(text, '^[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+|[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+$', '', 'g') AS trimmed FROM documents)
        SELECT lang, CASE WHEN text IS NULL THEN 'no text' WHEN length(trimmed) < 500 THEN 'too short' ELSE 'ok' END AS status, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS layout_chars,
               CAST(sum(length(regexp_replace(trimmed, '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g'))) AS BIGINT) AS plain_chars FROM d GROUP BY 1, 2""",
    "demo_questions": "SELECT * FROM (VALUES ('set', 'indexed', CAST(2 AS BIGINT)), ('document', 'indexed', 2), ('document', 'holdout', 1)) AS t(route, split, n)",
    "upsert_last_wins": f"WITH {_INDEX} SELECT document_id || '#' || index AS id, CASE WHEN key % 4 = 0 THEN 3 ELSE 0 END AS version FROM idx",
    "stale_last_total": f"WITH {_INDEX} SELECT DISTINCT document_id, CAST(total - 1 AS INTEGER) AS first, CAST(80 AS BIGINT) AS n FROM idx",
    "metadata_sizes": """SELECT doc_id, CAST(strlen('{' || concat_ws(',', '"l":"' || lang || '"', '"n":' || n_chars) || '}') AS BIGINT) AS bytes FROM documents""",
    "json_report": """SELECT '[' || string_agg('{"lang":"' || lang || '","n":' || n || '}', ',' ORDER BY lang) || ']' AS report FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""",
    "part_questions": f"WITH {CATALOGUE}, {_LABELS} SELECT part || ':' || dimension AS id, CASE WHEN held THEN 'holdout' ELSE 'indexed' END AS split, question, value, unit, names FROM pq",
    "question_summary": f"WITH {CATALOGUE}, {_LABELS} SELECT dimension, CASE WHEN held THEN 'holdout' ELSE 'indexed' END AS split, count(*) AS questions, count(DISTINCT part) AS parts FROM pq GROUP BY 1, 2",
    "questions_in_index": f"WITH {CATALOGUE}, {_LABELS} SELECT dimension, count(*) AS n FROM pq JOIN cat USING (part) WHERE p_partkey % 5 < 2 GROUP BY dimension",
    "metadata_present": "SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND page_id % 4 <> 0 AND url IS NOT NULL AND html IS NOT NULL",
    "unreadable_rows": "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'no object' WHEN p_partkey % 4 = 1 THEN 'empty' WHEN p_partkey % 8 = 3 THEN 'broken object' ELSE 'no object' END AS reason, count(*) AS n FROM part WHERE p_partkey % 4 <> 2 GROUP BY 1",
    "joined_agreement": f"WITH {CATALOGUE}, {_AGREEMENT} SELECT field, count(*) AS n, round(avg(CASE WHEN agrees THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS rate FROM f GROUP BY field",
    "joined_disagreements": f"WITH {CATALOGUE}, {_AGREEMENT} SELECT part, field, label FROM f WHERE NOT agrees",
    "answers_to_questions": f"WITH {_ANSWERS} SELECT dimension, reason, count(*) AS n FROM g WHERE qid % 9 <> 0 GROUP BY 1, 2",
    "id_subset": "SELECT o_orderkey AS id, o_orderkey % 13 = 0 AS refused FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 7)",
    "winners_seen": f"WITH {_CASES} SELECT saw_winner, winner_in_pool, count(*) AS n FROM c GROUP BY 1, 2",
    "mechanism_ratios": f"""WITH {_CASES} SELECT {_share('saw_winner', 'saw_winner IS NOT NULL')} AS winner_retrieved, {_share('NOT saw_winner', 'wrong AND saw_winner IS NOT NULL')} AS wrong_without_seeing_winner,
        {_share('NOT winner_in_pool', 'wrong AND winner_in_pool IS NOT NULL')} AS wrong_winner_not_in_pool, count(winner_in_pool) AS superlatives_graded FROM c""",
    "text_grades": "SELECT p_partkey, p_partkey % 3 <> 1 AS ok, true AS carries, p_partkey % 2 = 1 AS named FROM part",
    "rates_with_totals": f"WITH {_ANSWERS} SELECT dimension, grouping(dimension) = 1 AS is_total, count(*) AS n, round(avg(CASE WHEN reason = 'match' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS rate FROM g GROUP BY GROUPING SETS ((dimension), ())",
    "hallucinated_correct": f"""WITH {_ANSWERS} SELECT count(*) AS n, coalesce(round(avg(CASE WHEN coalesce(starts_with(CAST(CAST(found AS BIGINT) AS VARCHAR) || ' V', CAST(CAST(value AS BIGINT) AS VARCHAR)), false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4), 0.0::DOUBLE) AS share
        FROM g WHERE reason = 'hallucinated'""",
    "guard_rates": f"""WITH {CATALOGUE}, {_LABELS} SELECT held AS holdout, count(*) AS n, round(avg(CASE WHEN held AND p_partkey % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS refused FROM lab GROUP BY held""",
    "label_coverage": f"WITH {CATALOGUE} SELECT count(*) AS parts, count(channel) AS channel, count(vds) AS vds_v, count(*) FILTER (p_partkey % 7 <> 0) AS rdson_mohm, count(*) FILTER (p_partkey % 3 <> 0) AS id_a, count(*) FILTER (p_partkey % 2 = 0) AS package FROM cat",
    "name_check": "SELECT count(*) AS decoded, count(*) FILTER (p_partkey % 4 <> 1) AS vds_agrees, count(*) FILTER (p_partkey % 10 <> 0) AS rdson_agrees FROM part WHERE p_partkey % 16 NOT IN (2, 3)",
    "name_disagreements": """SELECT 'PSMN0' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-040K' || p_partkey AS part, p_partkey % 4 <> 1 AS vds_agrees, p_partkey % 10 <> 0 AS rdson_agrees
        FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 16 <> 2 ORDER BY part LIMIT 12""",
    "reference_current": """WITH r AS (SELECT l_orderkey AS part, ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS INTEGER) AS pos, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS value, l_linestatus = 'O' AS warm, l_returnflag <> 'R' AS always FROM lineitem)
        SELECT part, pos, value FROM r QUALIFY row_number() OVER (PARTITION BY part ORDER BY (warm AND always) DESC, warm DESC, pos) = 1""",
    "first_seen_chunks": f"""WITH {_RAG}, s AS (SELECT qid, chunk_id, 0 AS s, rank AS r FROM dense WHERE rank % 2 = 0 UNION ALL SELECT qid, chunk_id, 1, rank FROM dense WHERE rank <= 5),
        f AS (SELECT qid, chunk_id, min(s * 1000 + r) AS place FROM s GROUP BY 1, 2) SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM f""",
    "vocabulary_union": "SELECT p_brand AS name FROM part UNION SELECT p_type FROM part",
    "parse_datasheet": """SELECT 'PX' || p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN 'P' ELSE 'N' END AS channel, CAST(p_size AS DOUBLE) AS vds_v, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 500.0::DOUBLE END AS rdson, 'mΩ' AS unit,
        CAST(p_size AS DOUBLE) AS id, CAST(2 AS BIGINT) AS n_rdson, CAST(2 AS BIGINT) AS n_id, 'LFPAK56|Power-SO8|SOT669' AS package FROM part WHERE p_partkey % 10 <> 0""",
    "anchored_chunks": """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(doc_id AS VARCHAR) || chr(10) || coalesce(text, '') AS t FROM documents)
        SELECT document_id, CAST(least(length(t), 1800) AS BIGINT) AS visible, sha256(substr(regexp_replace(t, '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g'), 1, 100)) AS preview, 'https://docs/' || document_id AS url FROM a""",
    "plan_check": f"""WITH {CATALOGUE}, e AS (SELECT event_id AS id, event_id % 8 AS m, CAST(event_id % 100 AS DOUBLE) AS v FROM events),
        k AS (SELECT *, m = 0 AND v IN (SELECT abs(vds) FROM cat WHERE vds IS NOT NULL) AS rated, (SELECT min(p_brand) FROM cat WHERE lower(p_brand) = 'brand#11') AS brand FROM e)
        SELECT id, CASE WHEN m = 4 THEN 'lookup' WHEN rated OR m IN (2, 5, 6, 7) OR (m = 1 AND brand IS NOT NULL) THEN 'catalog' ELSE 'unsupported' END AS route,
               CASE WHEN rated THEN 'min' WHEN m = 1 AND brand IS NOT NULL THEN 'count' WHEN m IN (2, 7) THEN 'max' WHEN m = 5 THEN 'count' WHEN m = 6 THEN 'min' END AS op, CASE WHEN rated THEN 'rdson' WHEN m = 2 THEN 'id' WHEN m = 6 THEN 'rdson' WHEN m = 7 THEN 'vds' END AS field,
               CASE WHEN m = 1 AND brand IS NOT NULL THEN 'N' END AS channel, CASE WHEN rated THEN v END AS vds, CASE WHEN m = 1 THEN brand END AS package, CASE WHEN rated THEN 'Tj = 25 °C; VGS = 10 V' END AS conditions FROM k""",
    "set_answers": """SELECT o_orderkey, o_orderkey % 3 <> 0 AS count_right, o_orderkey % 2 = 1 OR CAST(floor(o_totalprice) AS BIGINT) % 5000 = 0 AS value_right FROM orders""",
    "hedges": "SELECT o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AS hedged, count(*) AS n FROM orders GROUP BY 1",
    "baseline_outcomes": "SELECT CASE WHEN o_orderkey % 19 = 0 THEN 'guard-refused' WHEN o_orderkey % 13 = 0 THEN 'model-refused' WHEN o_orderkey % 4 = 0 THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
    "decoded_responses": "SELECT CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '__UNREADABLE_RESPONSE__' END AS said, count(*) AS n FROM events GROUP BY 1",
    "engine_answers": f"""WITH {CATALOGUE} SELECT CAST(p_partkey AS VARCHAR) AS qid, CASE WHEN vds IS NULL THEN 'NOT_IN_CORPUS' ELSE CAST(CAST(abs(vds) AS BIGINT) AS VARCHAR) || ' V' END AS answer, vds IS NULL AS refused FROM cat WHERE p_partkey % 20 = 0""",
    "engine_extract": f"WITH {CATALOGUE} SELECT part, true AS readable, 'N' AS channel, abs(vds) AS vds FROM cat WHERE vds IS NOT NULL",
}
