"""The same queries as SQL for DuckDB, stated directly rather than as Spark runs them."""

from __future__ import annotations

from tagsieve.sources import tables
from workload.inputs import INTERCEPT, LABELS, VECTOR_TAGS

# White space as Unicode counts it, plus the ASCII separators.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = r"[\p{L}\p{N}_]{3,}"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def round4(expr: str) -> str:
    return f"round_even(({expr}) * 10000, 0) / 10000"


def round6(expr: str) -> str:
    return f"round_even(({expr}) * 1e6, 0) / 1e6"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{TOKEN}')"


def grams(words: str) -> str:
    return (
        f"list_concat({words}, list_transform(range(1, greatest(len({words}), 1)),"
        f" lambda i: {words}[i] || ' ' || {words}[i + 1]))"
    )


def with_(ctes: list[tuple[str, str]], query: str) -> str:
    seen, parts = set(), []
    for name, body in ctes:
        if name not in seen:
            seen.add(name)
            parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n" + query


REPORTS = [("reports", "SELECT doc_id, 'doc_' || doc_id AS nome, text AS texto FROM documents")]
SPACED = [
    (
        "reports",
        "SELECT doc_id, 'doc_' || doc_id AS nome, replace(text, chr(10), chr(10) || ' ' || chr(10)) AS texto FROM documents",
    )
]

# Paragraphs, then greedy packing of sentences as a fold over (finished, open) pairs.
CUT = [
    (
        "blocks",
        f"""SELECT doc_id, nome, list_filter(list_transform(
                string_split_regex(texto, '\\n[{WS}]*\\n+'), lambda b: {strip('b')}), lambda b: b <> '') AS paras
            FROM reports""",
    ),
    (
        "sentences",
        f"""SELECT doc_id, i, unnest(paras) AS para, unnest(range(1, len(paras) + 1)) AS p
            FROM (SELECT doc_id, 0 AS i, paras FROM blocks)""",
    ),
    (
        "packed",
        f"""SELECT doc_id, p, CASE WHEN length(para) <= 1200 THEN [para]
                   ELSE list_append(folded.done, folded.open) END AS pieces
            FROM (SELECT doc_id, p, para, list_reduce(
                      list_transform(
                        string_split(regexp_replace(para, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)),
                        lambda s: {{'done': []::VARCHAR[], 'open': s}}),
                      lambda a, s: CASE
                        WHEN length(a.open) + 1 + length(s.open) <= 1200
                          THEN {{'done': a.done, 'open': a.open || ' ' || s.open}}
                        ELSE {{'done': list_append(a.done, a.open), 'open': s.open}} END) AS folded
                  FROM sentences)""",
    ),
]
CUT += [
    (
        "pieces",
        "SELECT doc_id, p, unnest(pieces) AS trecho, unnest(range(1, len(pieces) + 1)) AS q FROM packed",
    ),
    (
        "chunks",
        """SELECT doc_id, nome AS arquivo, trecho, row_number() OVER (PARTITION BY doc_id ORDER BY p, q) AS trecho_id,
                  count(*) OVER (PARTITION BY doc_id) AS n_trechos
           FROM pieces JOIN reports USING (doc_id) WHERE length(trecho) >= 40""",
    ),
]
CHUNKS = REPORTS + CUT

REFS = [
    ("refs", "SELECT item_id AS ref_pos, text AS quotation FROM benchmark WHERE text IS NOT NULL AND text NOT IN ('', 'nan')"),
    (
        "ref_tf",
        f"SELECT ref_pos, term, count(*) AS rtf FROM (SELECT ref_pos, unnest({tokens('quotation')}) AS term FROM refs) GROUP BY ALL",
    ),
    ("ref_df", "SELECT term, count(*) AS df_ref FROM ref_tf GROUP BY term"),
]
IDF = CHUNKS + REFS + [
    (
        "chunk_tf",
        f"SELECT doc_id, n_trechos, trecho_id, term, count(*) AS tf FROM"
        f" (SELECT doc_id, n_trechos, trecho_id, unnest({tokens('trecho')}) AS term FROM chunks) GROUP BY ALL",
    ),
    ("doc_df", "SELECT doc_id, term, count(*) AS df_doc FROM chunk_tf GROUP BY ALL"),
    (
        "weighted",
        """SELECT doc_id, trecho_id, term, tf, df_doc, coalesce(df_ref, 0) AS df_ref,
                  ln((1.0 + (SELECT count(*) FROM refs) + n_trechos) / (1.0 + coalesce(df_ref, 0) + df_doc)) + 1 AS idf
           FROM chunk_tf JOIN doc_df USING (doc_id, term) LEFT JOIN ref_df USING (term)""",
    ),
    ("norms", "SELECT doc_id, trecho_id, sqrt(sum((tf * idf) ** 2)) AS norm FROM weighted GROUP BY ALL"),
]
# Every quotation's length under every report's weights, expanded term by term.
PAIRS = IDF + [
    ("docs", "SELECT DISTINCT doc_id, n_trechos FROM chunks"),
    (
        "ref_norms",
        """SELECT doc_id, ref_pos, sqrt(sum((rtf * (ln((1.0 + (SELECT count(*) FROM refs) + n_trechos)
                    / (1.0 + df_ref + coalesce(df_doc, 0))) + 1)) ** 2)) AS rnorm
           FROM docs CROSS JOIN ref_tf JOIN ref_df USING (term) LEFT JOIN doc_df USING (doc_id, term) GROUP BY ALL""",
    ),
    (
        "dots",
        """SELECT doc_id, trecho_id, ref_pos, sum(tf * idf * rtf * idf) AS dot
           FROM weighted JOIN ref_tf USING (term) GROUP BY ALL""",
    ),
    (
        "pairs",
        """SELECT doc_id, trecho_id, ref_pos, round_even(dot / (norm * rnorm) * 1e12, 0) / 1e12 AS sim
           FROM dots JOIN norms USING (doc_id, trecho_id) JOIN ref_norms USING (doc_id, ref_pos)""",
    ),
    (
        "best",
        """SELECT doc_id, trecho_id, max(sim) AS sim, arg_max(ref_pos, {'s': sim, 'p': -ref_pos}) AS ref_pos
           FROM pairs GROUP BY ALL""",
    ),
    (
        "nearest",
        """SELECT doc_id, arquivo, trecho_id, trecho, coalesce(sim, 0) AS sim,
                  coalesce(ref_pos, (SELECT min(ref_pos) FROM refs)) AS ref_pos
           FROM chunks LEFT JOIN best USING (doc_id, trecho_id)""",
    ),
    (
        "candidates",
        f"""SELECT doc_id, arquivo, trecho_id, trecho, {round4('sim')} AS similaridade, quotation AS quotation_referencia
            FROM nearest JOIN refs USING (ref_pos) WHERE {round4('sim')} >= 0.15""",
    ),
]

# The fixed model: top terms of the quotations, hashed coefficients.
MODEL = [
    (
        "item_terms",
        f"""SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({grams('w')}) AS term
            FROM (SELECT item_id, {tokens('text')} AS w FROM benchmark)) GROUP BY ALL""",
    ),
    (
        "model_terms",
        """SELECT term, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1 AS midf
           FROM (SELECT term, sum(c) AS n, count(*) AS df FROM item_terms GROUP BY term ORDER BY n DESC, term LIMIT 20000)""",
    ),
    ("model_tags", f"SELECT unnest({sql_list(LABELS)}) AS tag, unnest(range(0, {len(LABELS)})) AS idx"),
    (
        "coefficients",
        """SELECT term, midf, idx, (('0x' || substr(md5(term || ':' || idx), 1, 4))::INTEGER / 65535.0 - 0.5) * 8.0 AS coef
           FROM model_terms CROSS JOIN model_tags""",
    ),
]


def scoring(source: str) -> list[tuple[str, str]]:
    """Probabilities of (doc_id, trecho_id, trecho) rows under the fixed model."""
    return MODEL + [
        (
            "text_tf",
            f"""SELECT doc_id, trecho_id, term, count(*) AS tf FROM (SELECT doc_id, trecho_id, unnest({grams('w')}) AS term
                FROM (SELECT doc_id, trecho_id, {tokens('trecho')} AS w FROM {source})) GROUP BY ALL""",
        ),
        (
            "text_norms",
            "SELECT doc_id, trecho_id, sqrt(sum((tf * midf) ** 2)) AS norm FROM text_tf JOIN model_terms USING (term) GROUP BY ALL",
        ),
        (
            "text_dots",
            """SELECT doc_id, trecho_id, idx, sum(tf * midf * coef) AS dot
               FROM text_tf JOIN coefficients USING (term) GROUP BY ALL""",
        ),
        (
            "probs",
            f"""SELECT doc_id, trecho_id, idx, tag, 1 / (1 + exp(-(coalesce(dot / norm, 0) + ({INTERCEPT})))) AS prob
                FROM {source} CROSS JOIN model_tags LEFT JOIN text_dots USING (doc_id, trecho_id, idx)
                LEFT JOIN text_norms USING (doc_id, trecho_id)""",
        ),
        (
            "decoded",
            f"""SELECT doc_id, trecho_id,
                  string_agg(tag, ' | ' ORDER BY idx) FILTER (WHERE prob >= 0.5) AS tags_preditas,
                  {round4('max(prob)')} AS confianca,
                  count(*) FILTER (WHERE prob >= 0.5) AS numero_tags,
                  max(prob) < 0.7 AS revisar
                FROM probs GROUP BY ALL""",
        ),
    ]


RESULTS = PAIRS + scoring("candidates") + [("results", "SELECT * FROM candidates JOIN decoded USING (doc_id, trecho_id)")]
RESULT_TAGS = RESULTS + [
    (
        "found_tags",
        f"""SELECT doc_id, arquivo, tag FROM (SELECT doc_id, arquivo,
              {strip("unnest(string_split(tags_preditas, '|'))")} AS tag FROM results) WHERE tag <> ''""",
    ),
    ("tag_counts", "SELECT doc_id, arquivo, tag, count(*) AS n FROM found_tags GROUP BY ALL"),
    ("known", f"SELECT unnest({sql_list(LABELS)}) AS tag"),
    (
        "absent",
        """SELECT doc_id, arquivo, tag FROM (SELECT DISTINCT doc_id, arquivo FROM results) CROSS JOIN known
           ANTI JOIN tag_counts USING (doc_id, arquivo, tag)""",
    ),
    (
        "evidence",
        """SELECT *, row_number() OVER (PARTITION BY doc_id, arquivo ORDER BY confianca DESC, trecho_id) AS pos
           FROM results WHERE tags_preditas IS NOT NULL QUALIFY pos <= 30""",
    ),
]
PERCENT = "round_even(confianca * 100, 0)::BIGINT || '%'"
BRIEF = RESULT_TAGS + [
    (
        "brief",
        f"""SELECT doc_id, arquivo, n_total, n_revisar, tags, tag_lines, ausentes, absent_lines, evidencias, evidence_lines
            FROM (SELECT doc_id, arquivo, count(*) AS n_total, count(*) FILTER (WHERE revisar) AS n_revisar
                  FROM results GROUP BY ALL)
            LEFT JOIN (SELECT doc_id, arquivo, string_agg(tag || '=' || n, ';' ORDER BY n DESC, tag) AS tags,
                         string_agg('* ' || tag || ' - ' || n || ' chunk(s)', chr(10) ORDER BY n DESC, tag) AS tag_lines
                       FROM tag_counts GROUP BY ALL) USING (doc_id, arquivo)
            LEFT JOIN (SELECT doc_id, arquivo, string_agg(tag, ';' ORDER BY tag) AS ausentes,
                         string_agg('* ' || tag, chr(10) ORDER BY tag) AS absent_lines
                       FROM absent GROUP BY ALL) USING (doc_id, arquivo)
            LEFT JOIN (SELECT doc_id, arquivo, string_agg(tags_preditas || '=' || {PERCENT} || '=' || substr(trecho, 1, 400), ';'
                         ORDER BY pos) AS evidencias,
                         string_agg('* "' || substr(trecho, 1, 400) || '"' || chr(10) || '  ' || tags_preditas || ' at ' || {PERCENT},
                         chr(10) ORDER BY pos) AS evidence_lines
                       FROM evidence GROUP BY ALL) USING (doc_id, arquivo)""",
    )
]


def brief_layout(title: str, tags: str, absent: str, evidence: str) -> str:
    gap = "chr(10) || chr(10) ||"
    return f"""'Report: ' || {title} || chr(10) || 'Chunks classified: ' || n_total || chr(10) || 'Chunks to review: ' || n_revisar
      || {gap} 'Tags found' || chr(10) || coalesce({tags}, '* no tag was found')
      || {gap} 'Known tags that do not occur' || chr(10) || coalesce({absent}, '* every known tag occurs')
      || {gap} 'Strongest evidence' || chr(10) || coalesce({evidence}, '* no chunk was tagged')"""


TABLE_COLUMNS = "arquivo, trecho, similaridade, tags_preditas, confianca, numero_tags, revisar"

# Annotated quotations, corrections and the merged training base.
CODES = "'quality ' || quality || ' , toxic ' || toxic || ';' || lang || chr(9) || '| ' || source || ' ,' || lang || ';'"
ANNOTATED = [
    ("annotated", f"SELECT doc_id AS ref_pos, text AS quotation, {CODES} AS codes FROM labels JOIN documents USING (doc_id)"),
    (
        "reviews",
        """SELECT doc_id AS seq, text AS quotation, CASE WHEN toxic = 1 THEN 'checked ; toxic 1'
             ELSE 'checked | low quality,' || lang END AS codes
           FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 OR quality = 0""",
    ),
]


def tag_list(expr: str) -> str:
    """Ordered list without repeats."""
    parts = f"list_filter(list_transform(regexp_split_to_array({expr}, '[,;|]'), lambda t: {strip('t')}), lambda t: t <> '')"
    return f"list_filter({parts}, lambda t, i: list_position({parts}, t) = i)"


BASE = ANNOTATED + [
    (
        "merged",
        """SELECT row_id, quotation, codes FROM (
             SELECT 'o' || ref_pos AS row_id, 0 AS src, ref_pos AS seq, quotation, codes FROM annotated
             UNION ALL SELECT 'r' || seq, 1, seq, quotation, codes FROM reviews)
           WHERE true QUALIFY row_number() OVER (PARTITION BY quotation ORDER BY src DESC, seq DESC) = 1""",
    ),
    (
        "base",
        "SELECT * FROM merged WHERE quotation NOT IN ('', 'nan') AND codes NOT IN ('', 'nan')",
    ),
    ("tagged", f"SELECT row_id, quotation, {tag_list('codes')} AS tags FROM base"),
    ("tag_rows", "SELECT row_id, unnest(tags) AS tag FROM tagged"),
    ("freq", "SELECT tag, count(*) AS n FROM tag_rows GROUP BY tag"),
    ("kept", "SELECT tag, n, row_number() OVER (ORDER BY tag) - 1 AS idx FROM freq WHERE n >= 5"),
    (
        "rows_kept",
        """SELECT row_id, quotation, list_filter(tags, lambda t: list_contains(allowed, t)) AS tags
           FROM tagged CROSS JOIN (SELECT list(tag) AS allowed FROM kept)""",
    ),
]
# The greedy walk, one row per step: how many training rows each tag has left.
SPLIT = BASE + [
    (
        "walk_order",
        "SELECT row_id, tags, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS step FROM rows_kept",
    ),
    ("target", "SELECT round_even(count(*) * 0.2, 0)::BIGINT AS size FROM rows_kept"),
]
WALK = """walk(step, row_id, moved, n_test, remaining) AS (
    SELECT 0::BIGINT, NULL::VARCHAR, false, 0::BIGINT, (SELECT map_from_entries(list((tag, n))) FROM kept)
    UNION ALL
    SELECT step, row_id, ok, n_test + ok::BIGINT,
           CASE WHEN ok THEN map_from_entries(list_transform(map_entries(remaining),
                lambda e: (e.key, e.value - list_contains(tags, e.key)::BIGINT))) ELSE remaining END
    FROM (SELECT w.step + 1 AS step, o.row_id, o.tags, w.n_test, w.remaining,
                 w.n_test < (SELECT size FROM target)
                 AND len(list_filter(o.tags, lambda t: w.remaining[t] - 1 < 2)) = 0 AS ok
          FROM walk w JOIN walk_order o ON o.step = w.step + 1))"""


def with_walk(query: str, more: list[tuple[str, str]] = ()) -> str:
    body = with_([*SPLIT], "").rstrip()
    tail = "".join(f",\n{name} AS ({text})" for name, text in more)
    flags = (
        ",\nflagged AS (SELECT r.row_id, r.quotation, r.tags, w.moved AS is_test"
        " FROM rows_kept r JOIN walk w USING (row_id))"
    )
    return body.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + WALK + flags + tail + "\n" + query


COUNTS = [
    ("train_n", "SELECT count(*) AS n FROM flagged WHERE NOT is_test"),
    ("train_pos", "SELECT unnest(tags) AS tag, row_id FROM flagged WHERE NOT is_test"),
    (
        "counts",
        """SELECT k.idx, k.tag, (SELECT n FROM train_n) AS n, count(p.row_id) AS pos
           FROM kept k LEFT JOIN train_pos p USING (tag) GROUP BY ALL""",
    ),
]

BASE_TERMS = BASE + [
    (
        "base_terms",
        f"SELECT row_id, unnest({grams('w')}) AS term FROM (SELECT row_id, {tokens('quotation')} AS w FROM base)",
    ),
    ("top", "SELECT term, count(*) AS n FROM base_terms GROUP BY term ORDER BY n DESC, term LIMIT 20000"),
]

VECTORS = [
    (
        "logits",
        """SELECT vec_id AS doc_id, label, unnest(embedding)::DOUBLE * 8 AS logit,
                  unnest(range(0, len(embedding))) AS idx FROM embeddings""",
    ),
    ("vec_tags", f"SELECT unnest({sql_list(VECTOR_TAGS)}) AS tag, unnest(range(0, {len(VECTOR_TAGS)})) AS idx"),
    ("vec_probs", "SELECT doc_id, label, idx, tag, 1 / (1 + exp(-logit)) AS prob FROM logits JOIN vec_tags USING (idx)"),
    (
        "vec_decoded",
        f"""SELECT doc_id, string_agg(tag, ' | ' ORDER BY idx) FILTER (WHERE prob >= 0.5) AS tags_preditas,
              {round4('max(prob)')} AS confianca, count(*) FILTER (WHERE prob >= 0.5) AS numero_tags,
              max(prob) < 0.7 AS revisar FROM vec_probs GROUP BY ALL""",
    ),
]


def f1(models: dict[str, float], threshold: float) -> str:
    union = " UNION ALL ".join(
        f"SELECT {quote(name)} AS model, idx, label = idx AS truth, 1 / (1 + exp(-logit * {factor})) >= {threshold} AS said FROM logits"
        for name, factor in models.items()
    )
    per_tag = """SELECT model, tp, fp, fn, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1
        FROM (SELECT model, idx, count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp,
              count(*) FILTER (WHERE truth AND NOT said) AS fn FROM said GROUP BY ALL)"""
    return with_(
        [*VECTORS[:1], ("said", union), ("per_tag", per_tag)],
        f"""SELECT model, {round6('avg(f1)')} AS f1_macro,
              {round6('CASE WHEN sum(2 * tp + fp + fn) > 0 THEN sum(2 * tp) / sum(2 * tp + fp + fn) ELSE 0 END')} AS f1_micro,
              {round6('CASE WHEN sum(tp + fn) > 0 THEN sum((tp + fn) * f1) / sum(tp + fn) ELSE 0 END')} AS f1_weighted
            FROM per_tag GROUP BY model""",
    )


def wide_columns() -> str:
    return ", ".join(
        f'{round4(f"max(prob) FILTER (WHERE idx = {i})")} AS "prob_{tag.replace(" ", ".")}"'
        for i, tag in enumerate(VECTOR_TAGS)
    )


BATCH_LABELS = ["long", "many a", "many e", "many i"]


def batch_scores() -> str:
    vowels = "".join(
        f", 2.0 * (length(lower(trecho)) - length(replace(lower(trecho), '{v}', ''))) / 100 - 2.0" for v in "aei"
    )
    return with_(
        CHUNKS
        + [
            ("scored", f"SELECT doc_id, trecho_id, [2.0 * length(trecho) / 600 - 2.0{vowels}] AS logits FROM chunks"),
            (
                "p",
                f"""SELECT doc_id, trecho_id, 1 / (1 + exp(-unnest(logits))) AS prob,
                      unnest({sql_list(BATCH_LABELS)}) AS tag, unnest(range(0, 4)) AS idx FROM scored""",
            ),
        ],
        f"""SELECT doc_id, trecho_id, string_agg(tag, ' | ' ORDER BY idx) FILTER (WHERE prob >= 0.5) AS tags_preditas,
              {round4('max(prob)')} AS confianca, count(*) FILTER (WHERE prob >= 0.5) AS numero_tags, max(prob) < 0.7 AS revisar
            FROM p GROUP BY ALL""",
    )


TAXONOMY = [
    (
        "taxonomy",
        " UNION ALL ".join(
            f"SELECT {i} AS block_pos, {quote(block)} AS block, {j} AS tag_pos, {quote(tag)} AS tag, {quote(f'{block}: {tag}')} AS full_tag"
            for i, (block, tags) in enumerate(tables.TAXONOMY.items())
            for j, tag in enumerate(tags)
        ),
    )
]
FULL_TAGS = sql_list(tables.full_tags())

EDITED_TAGS = "list_filter(tags, lambda t: t NOT IN ('quality 0', 'quality 1'))"
EXTENSION = "CASE lang WHEN 'en' THEN 'TXT' WHEN 'fr' THEN 'txt' WHEN 'de' THEN 'doc' ELSE 'pdf' END"

LINEAR_SCORES = with_(
    [("items", "SELECT doc_id, 1 AS trecho_id, text AS trecho FROM documents")] + scoring("items"),
    f"SELECT doc_id, trecho_id, idx, tag, {round6('prob')} AS prob FROM probs",
)

ORACLES = {
    "analyze": with_(RESULTS, "SELECT * FROM results ORDER BY confianca DESC, arquivo, trecho_id"),
    "read_quotations": with_(ANNOTATED, "SELECT ref_pos, quotation, codes FROM annotated"),
    "read_reports": """SELECT source, sum(length(line) + 1)::BIGINT AS n_chars, count(*) AS n_lines,
        sum(('0x' || substr(md5(line), 1, 8))::BIGINT)::BIGINT AS digest
        FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source""",
    "read_docx": f"""SELECT doc_id::VARCHAR AS nome, array_to_string(list_filter(list_transform(
        string_split(text, chr(10)), lambda l: {strip('l')}), lambda l: l <> ''), chr(10) || chr(10)) AS texto
        FROM documents WHERE {strip('text')} <> ''""",
    "docx_intake": f"""SELECT path, CASE WHEN NOT rejected THEN texto END AS texto, rejected FROM (
        SELECT 'in/' || doc_id || '.docx' AS path, doc_id % 7 = 0 OR doc_id % 5 = 0 AS rejected, text,
               array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), lambda l: l <> ''),
                 chr(10) || chr(10)) AS texto
        FROM documents) WHERE rejected OR {strip('text')} <> ''
        UNION ALL SELECT 'in/bomb.docx', NULL, TRUE""",
    "report_intake": f"""SELECT path, CASE WHEN ok THEN 'report.v' || doc_id END AS nome, CASE WHEN ok THEN text END AS texto,
        CASE WHEN ok THEN NULL WHEN ext = 'doc' THEN 'old .doc files are not supported: save as .docx'
             ELSE 'format ''.' || ext || ''' is not supported: send .txt or .docx' END AS reason
        FROM (SELECT doc_id, text, 'in/report.v' || doc_id || '.' || {EXTENSION} AS path, lower({EXTENSION}) AS ext,
              lower({EXTENSION}) = 'txt' AS ok FROM documents) WHERE NOT ok OR {strip('text')} <> ''""",
    "label_vocab": with_(
        ANNOTATED,
        f"""SELECT row_number() OVER (ORDER BY tag) - 1 AS idx, tag
            FROM (SELECT DISTINCT unnest({tag_list('codes')}) AS tag FROM annotated)""",
    ),
    "clean_quotations": with_(
        ANNOTATED, "SELECT ref_pos, quotation, codes FROM annotated WHERE quotation NOT IN ('', 'nan') AND NOT contains(codes, 'quality 0')"
    ),
    "paragraphs": with_(SPACED + CUT[:2], "SELECT doc_id, p AS para, para AS paragraph FROM sentences"),
    "chunks": with_(CHUNKS, "SELECT * FROM chunks"),
    "paragraph_chunks": with_(SPACED + CUT, "SELECT * FROM chunks"),
    "chunk_counts": with_(
        SPACED + CUT,
        """SELECT doc_id, nome AS arquivo, len(paras) AS n_paragrafos, coalesce(n, 0) AS n_trechos
           FROM blocks LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) USING (doc_id)""",
    ),
    "tokens": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY ALL",
    "ngrams": f"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({grams('w')}) AS term
        FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)) GROUP BY ALL""",
    "tag_lists": with_(ANNOTATED, f"SELECT ref_pos, array_to_string({tag_list('codes')}, ' | ') AS tags FROM annotated"),
    "term_idf": with_(IDF, f"SELECT doc_id, trecho_id, term, tf, df_doc, df_ref, {round6('idf')} AS idf FROM weighted"),
    "chunk_norms": with_(IDF, f"SELECT doc_id, trecho_id, {round6('norm')} AS norm FROM norms"),
    "similarity_pairs": with_(PAIRS, f"SELECT doc_id, trecho_id, ref_pos, {round6('sim')} AS sim FROM pairs WHERE sim >= 0.05"),
    "nearest_reference": with_(PAIRS, f"SELECT doc_id, trecho_id, {round4('sim')} AS sim, ref_pos FROM nearest"),
    "candidates": with_(PAIRS, "SELECT * FROM candidates"),
    "results": with_(
        RESULTS,
        f"""SELECT arquivo, trecho_id, similaridade, idx, tag, {round4('prob')} AS prob
            FROM candidates JOIN probs USING (doc_id, trecho_id)""",
    ),
    "results_tagged": with_(RESULTS, f"SELECT {TABLE_COLUMNS} FROM results WHERE tags_preditas IS NOT NULL"),
    "results_by_file": with_(RESULTS, f"SELECT {TABLE_COLUMNS} FROM results WHERE arquivo = (SELECT min(arquivo) FROM results)"),
    "report_names": with_(RESULTS, "SELECT DISTINCT arquivo FROM results ORDER BY arquivo"),
    "top20": with_(
        RESULTS,
        "SELECT arquivo, trecho_id, tags_preditas, confianca FROM results ORDER BY confianca DESC, arquivo, trecho_id LIMIT 20",
    ),
    "result_summary": with_(
        RESULTS,
        f"""SELECT count(*) AS n_trechos, count(*) FILTER (WHERE revisar) AS n_revisar,
              {round6('avg(confianca)')} AS confianca_media FROM results""",
    ),
    "report_coverage": with_(
        RESULTS,
        """SELECT count(DISTINCT arquivo) AS n_com_resultado, (SELECT count(*) FROM reports) AS n_relatorios,
             count(*) AS n_trechos FROM results""",
    ),
    "report_status": with_(
        PAIRS,
        """SELECT doc_id, nome AS arquivo, coalesce(n, 0) AS n_trechos, coalesce(c, 0) AS n_candidatos,
             CASE WHEN n IS NULL THEN 'sem trechos' WHEN c IS NULL THEN 'sem candidatos' ELSE 'classificado' END AS status
           FROM reports LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY ALL) USING (doc_id)
           LEFT JOIN (SELECT doc_id, count(*) AS c FROM candidates GROUP BY ALL) USING (doc_id)""",
    ),
    "report_tag_counts": with_(RESULT_TAGS, "SELECT * FROM tag_counts"),
    "taxonomy": with_(
        RESULT_TAGS + TAXONOMY,
        """SELECT block_pos, block, tag_pos, tag, full_tag, coalesce(u.n, 0)::BIGINT AS n FROM taxonomy
           LEFT JOIN (SELECT tag AS full_tag, sum(n) AS n FROM tag_counts GROUP BY tag) u USING (full_tag)""",
    ),
    "absent_tags": with_(RESULT_TAGS, "SELECT * FROM absent"),
    "brief_evidence": with_(
        RESULT_TAGS,
        f"""SELECT doc_id, arquivo, pos, trecho_id, substr(trecho, 1, 400) AS trecho, tags_preditas, confianca,
              {PERCENT} AS confianca_pct FROM evidence""",
    ),
    "brief_inputs": with_(
        BRIEF,
        """SELECT doc_id, arquivo, n_total, n_revisar, tags, coalesce(ausentes, '') AS ausentes, evidencias FROM brief""",
    ),
    "brief_text": with_(
        BRIEF,
        f"SELECT arquivo, {brief_layout('arquivo', 'tag_lines', 'absent_lines', 'evidence_lines')} AS texto FROM brief",
    ),
    "brief_all": with_(
        RESULT_TAGS
        + [
            (
                "whole",
                f"""SELECT count(*) AS n_total, count(*) FILTER (WHERE revisar) AS n_revisar,
                    (SELECT string_agg('* ' || tag || ' - ' || n || ' chunk(s)', chr(10) ORDER BY n DESC, tag)
                     FROM (SELECT tag, count(*) AS n FROM found_tags GROUP BY tag)) AS tag_lines,
                    (SELECT string_agg('* ' || tag, chr(10) ORDER BY tag) FROM known ANTI JOIN found_tags USING (tag)) AS absent_lines,
                    (SELECT string_agg('* "' || substr(trecho, 1, 400) || '"' || chr(10) || '  ' || tags_preditas || ' at ' || {PERCENT},
                       chr(10) ORDER BY confianca DESC, arquivo, trecho_id)
                     FROM (SELECT * FROM results WHERE tags_preditas IS NOT NULL
                           ORDER BY confianca DESC, arquivo, trecho_id LIMIT 30)) AS evidence_lines FROM results""",
            )
        ],
        f"SELECT n_total, n_revisar, {brief_layout(quote('all'), 'tag_lines', 'absent_lines', 'evidence_lines')} AS texto FROM whole",
    ),
    "review_queue": with_(
        RESULTS,
        f"""SELECT arquivo, trecho, tags_preditas AS tag_prevista_pelo_modelo,
              coalesce(array_to_string(list_filter(list_transform(string_split(tags_preditas, '|'), lambda t: {strip('t')}),
                lambda t: list_contains({FULL_TAGS}, t)), ' | '), '') AS tags_corrigidas,
              confianca, false AS incluir_no_treino FROM results WHERE revisar""",
    ),
    "append_reviews": with_(
        ANNOTATED,
        f"""SELECT nullif(quotation, '') AS quotation, codes, '2024-01-01 00:00' AS data_revisao FROM reviews
            UNION ALL SELECT quotation, array_to_string({EDITED_TAGS}, ' | '), '2024-05-06 07:08'
            FROM (SELECT quotation, {tag_list('codes')} AS tags FROM annotated)
            WHERE list_contains(tags, 'toxic 1') AND len({EDITED_TAGS}) > 0""",
    ),
    "upsert_reviews": with_(
        ANNOTATED,
        f"""SELECT quotation, codes, seq FROM (
              SELECT 0 AS src, seq, quotation, codes FROM reviews UNION ALL
              SELECT 1, ref_pos, quotation, array_to_string(tags, ' | ')
              FROM (SELECT ref_pos, quotation, {tag_list('codes')} AS tags FROM annotated)
              WHERE list_contains(tags, 'toxic 1') AND quotation <> '')
            WHERE true QUALIFY row_number() OVER (PARTITION BY quotation ORDER BY src DESC, seq DESC) = 1""",
    ),
    "review_loop": with_(
        ANNOTATED,
        f"""SELECT quotation, codes FROM (
              SELECT 0 AS src, ref_pos AS seq, quotation, codes FROM annotated
              UNION ALL SELECT 1, seq, quotation, codes FROM reviews
              UNION ALL SELECT CASE WHEN again THEN 3 ELSE 2 END, ref_pos,
                quotation, array_to_string({EDITED_TAGS}, ' | ') || CASE WHEN again THEN ' | again' ELSE '' END
              FROM (SELECT ref_pos, quotation, {tag_list('codes')} AS tags FROM annotated), (VALUES (false), (true)) v(again)
              WHERE list_contains(tags, 'toxic 1') AND len({EDITED_TAGS}) > 0 AND (NOT again OR list_contains(tags, 'en')))
            WHERE quotation IS NOT NULL AND quotation NOT IN ('', 'nan') AND codes IS NOT NULL AND codes NOT IN ('', 'nan')
            QUALIFY row_number() OVER (PARTITION BY quotation ORDER BY src DESC, seq DESC) = 1""",
    ),
    "review_version": with_(
        ANNOTATED,
        f"""SELECT *, (SELECT count(*) FROM (SELECT quotation, {tag_list('codes')} AS tags FROM annotated)
                       WHERE list_contains(tags, 'toxic 1') AND quotation <> '') AS saved
            FROM (SELECT quotation, codes, seq FROM (
              SELECT 0 AS src, seq, quotation, codes FROM reviews UNION ALL
              SELECT 1, ref_pos, quotation, array_to_string(tags, ' | ')
              FROM (SELECT ref_pos, quotation, {tag_list('codes')} AS tags FROM annotated)
              WHERE list_contains(tags, 'toxic 1') AND quotation <> '')
            WHERE true QUALIFY row_number() OVER (PARTITION BY quotation ORDER BY src DESC, seq DESC) = 1)""",
    ),
    "training_base": with_(BASE, "SELECT row_id, quotation, codes FROM base"),
    "tag_frequency": with_(BASE, "SELECT tag, n FROM freq ORDER BY n DESC, tag"),
    "tag_vocab": with_(BASE, "SELECT row_number() OVER (ORDER BY tag) - 1 AS idx, tag FROM freq"),
    "rare_tags": with_(BASE, "SELECT tag, n, n >= 5 AS kept FROM freq"),
    "rows_after_rare": with_(BASE, "SELECT row_id, array_to_string(tags, ' | ') AS tags FROM rows_kept"),
    "label_matrix": with_(BASE, "SELECT row_id, idx FROM tag_rows JOIN kept USING (tag)"),
    "split": with_walk("SELECT row_id, is_test FROM flagged"),
    "random_split": with_(
        BASE,
        """SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id)
             <= (SELECT round_even(count(*) * 0.2, 0) FROM tagged) AS is_test FROM tagged""",
    ),
    "training_set": with_walk("SELECT row_id, quotation, array_to_string(tags, ' | ') AS tags, is_test FROM flagged"),
    "untrained_tags": with_(
        BASE,
        """SELECT idx, tag FROM (SELECT row_number() OVER (ORDER BY tag) - 1 AS idx, tag FROM freq)
           ANTI JOIN (SELECT unnest(tags) AS tag FROM tagged WHERE row_id NOT IN (
             SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS pos FROM tagged)
             WHERE pos <= (SELECT round_even(count(*) * 0.2, 0) FROM tagged))) USING (tag)""",
    ),
    "pos_weight": with_walk(
        f"""SELECT idx, tag, pos, n - pos AS neg,
              {round6('least(greatest((n - pos) / greatest(pos, 1), 1.0), 15.0)')} AS pos_weight FROM counts""",
        COUNTS,
    ),
    "class_weight": with_walk(
        f"""SELECT idx, tag, CASE WHEN pos > 0 THEN {round6('n / (2.0 * pos)')} END AS weight_pos,
              CASE WHEN n - pos > 0 THEN {round6('n / (2.0 * (n - pos))')} END AS weight_neg FROM counts""",
        COUNTS,
    ),
    "top_terms": with_(BASE_TERMS, "SELECT term, n FROM top ORDER BY n DESC, term"),
    "tfidf_features": with_(
        BASE_TERMS
        + [
            ("tf", "SELECT row_id, term, count(*) AS tf FROM base_terms SEMI JOIN top USING (term) GROUP BY ALL"),
            ("df", "SELECT term, ln((1.0 + (SELECT count(*) FROM base)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term"),
            ("w", "SELECT row_id, term, tf * idf AS w FROM tf JOIN df USING (term)"),
        ],
        f"SELECT row_id, term, {round6('w / sqrt(sum(w * w) OVER (PARTITION BY row_id))')} AS weight FROM w",
    ),
    "vectorizer_files": with_(
        BASE_TERMS
        + [
            ("tf", "SELECT row_id, term, count(*) AS tf FROM base_terms SEMI JOIN top USING (term) GROUP BY ALL"),
            ("df", "SELECT term, ln((1.0 + (SELECT count(*) FROM base)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term"),
            ("w", "SELECT row_id, term, tf * idf AS w FROM tf JOIN df USING (term)"),
        ],
        f"SELECT row_id, term, {round6('w / sqrt(sum(w * w) OVER (PARTITION BY row_id))')} AS weight FROM w",
    ),
    "train_lr": with_walk("SELECT idx, tag, n AS n_train, pos AS n_pos, pos > 0 AND pos < n AS optimal FROM counts", COUNTS),
    "train_f1": with_walk(
        """SELECT idx, tag, (SELECT count(*) FROM flagged WHERE is_test) AS n_test,
             (SELECT count(*) FROM flagged f WHERE is_test AND list_contains(f.tags, c.tag)) AS n_true,
             TRUE AS f1_stored, TRUE AS f1_better FROM counts c""",
        COUNTS,
    ),
    "run_stats": with_walk(
        """SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT is_test) AS n_train, count(*) FILTER (WHERE is_test) AS n_test,
             (SELECT count(*) FROM kept) AS n_tags, (SELECT sum(len(paras))::BIGINT FROM blocks) AS n_paragrafos,
             (SELECT count(*) FROM chunks) AS n_trechos FROM flagged""",
        SPACED + CUT,
    ),
    "linear_scores": LINEAR_SCORES,
    "model_files": LINEAR_SCORES,
    "sigmoid_scores": with_(VECTORS, f"SELECT doc_id, idx, {round6('prob')} AS prob FROM vec_probs"),
    "decode_scores": with_(VECTORS, "SELECT * FROM vec_decoded"),
    "wide_scores": with_(
        VECTORS,
        f"""SELECT doc_id, {round4('max(prob)')} AS confianca, count(*) FILTER (WHERE prob >= 0.5) AS numero_tags,
              max(prob) < 0.7 AS revisar, {wide_columns()} FROM vec_probs GROUP BY doc_id""",
    ),
    "batch_scores": batch_scores(),
    "f1_metrics": f1({"vectors": 1.0}, 0.5),
    "model_comparison": f1({"plain": 1.0, "sharp": 3.0}, 0.9),
    "result_files": with_(
        VECTORS + [("known", f"SELECT unnest({sql_list(LABELS)}) AS tag")],
        f"""SELECT 'resultado_2_relatorios_20240506_0708' AS nome, 'resultados' AS parte, doc_id::VARCHAR AS chave, tags_preditas,
              confianca, numero_tags::BIGINT AS numero, revisar, soma
            FROM vec_decoded JOIN (SELECT doc_id, {round6('sum(prob)')} AS soma FROM vec_probs GROUP BY doc_id) USING (doc_id)
            UNION ALL SELECT 'resultado_2_relatorios_20240506_0708', 'frequencia_tags', tag, NULL, NULL, NULL, NULL, NULL FROM known""",
    ),
    "result_csv": with_(RESULTS, "SELECT doc_id, trecho_id, trecho, confianca, revisar, tags_preditas AS tags FROM results"),
    "label_files": with_(BASE, "SELECT tag, f.n, coalesce(idx, -1) AS idx FROM freq f LEFT JOIN (SELECT tag, idx FROM kept) USING (tag)"),
}
