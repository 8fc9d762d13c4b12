"""Queries over text blocks: ids, dates, hashes, tokens, sentences, markers, mentions, census."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, hashing, ids
from ..functions import vocabulary as V
from ..functions.text import tidy
from ..operators import lexical as L
from ..operators.membership import propose
from ..session import table


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "open_blocks").filter("provider_style_id is null or provider_style_id not in ('s9', 's9header')")


def id_validation(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "valid_items")
    return i.select(F.coalesce("id", F.lit("")).alias("id"), ids.id_error("id").alias("error"), ids.id_error("id", 8).alias("short_error"), ids.path_error(F.concat_ws("/", "id", "owner")).alias("path_error"), ids.depth_of("owner").alias("depth"))


def minted_works(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edition_summaries").select("edition_number", F.col("revision_date").alias("day")).distinct()
    w, error = ids.work_id(F.lit("federal"), F.col("day"), F.concat(F.col("edition_number").cast("string"), F.lit("-fz")))
    return e.select("edition_number", F.coalesce("day", F.lit("")).alias("day"), F.coalesce(w, F.lit("")).alias("work"), error.alias("error"), F.coalesce(ids.expression_id(w, dates.day_ordinal(F.col("day"))), F.lit("")).alias("expression"), F.coalesce(ids.urn(w), F.lit("")).alias("urn"))


def day_ordinals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edition_summaries").select("edition_number", "revision_date").distinct()
    n = dates.day_ordinal(F.col("revision_date"))
    return e.select("edition_number", F.coalesce("revision_date", F.lit("")).alias("day"), F.coalesce(n, F.lit(-1)).alias("ordinal"), dates.day_error(F.col("revision_date")).alias("error"), F.coalesce(dates.ordinal_day(n), F.lit("")).alias("back"))


def dates_in_names(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").select("obs_id", "context_sample")
    return o.select("obs_id", F.coalesce(dates.date_in_name(F.col("context_sample")), F.lit("")).alias("day"), F.coalesce(dates.act_number_in_name(F.col("context_sample")), F.lit("")).alias("act"))


def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").filter("link_text is not null").select("obs_id", F.sha2("link_text", 256).alias("sha"), hashing.joined_digest(F.col("link_text"), F.col("context_sample"), F.col("status")).alias("digest"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").filter("link_text is not null").select("link_text").distinct().select("link_text", hashing.fnv1a64(F.col("link_text")).alias("fingerprint"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.tokens(_blocks(spark, d), ["block_id"], "text").groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("block_id").alias("n_blocks"))


def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    t = L.tokens(_blocks(spark, d), ["block_id"], "text")
    return t.groupBy("block_id").agg(F.count("*").alias("n"), F.max("end").alias("last_end"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = L.sentences(table(spark, d, "article_texts"), ["article_id"], "text")
    return s.groupBy("article_id").agg(F.count("*").alias("n"), F.max("end").alias("last_end"))


def reference_mentions(spark: SparkSession, d: str) -> DataFrame:
    return L.mentions(table(spark, d, "article_texts").select("article_id", "text"), ["article_id"], "text").groupBy("kind", "number").agg(F.count("*").alias("n"))


#: Clauses that the given texts lack: each text is read with one of them at its end.
CLAUSES = [
    " Лицо не обязано хранить копию.", " Орган вправе отказать; стороны обязаны\tуведомить.", " Вывоз запрещается, вход не \u00a0запрещён.", " Он не-обязан и не; вправе.",
    " Приказ вступил в силу.", " Закон утратил силу, норма утрачивает  силу.", " Акт утратил в силу.", " Вступают\tв\nсилу статьи, вступает в силу.",
]


def _clauses(spark: SparkSession, d: str) -> DataFrame:
    clause = F.element_at(F.array(*[F.lit(x) for x in CLAUSES]), (F.col("article_id") % len(CLAUSES) + 1).cast("int"))
    return table(spark, d, "article_texts").select("article_id", F.concat(F.coalesce("text", F.lit("")), clause).alias("text"))


def marker_words(spark: SparkSession, d: str) -> DataFrame:
    return L.words(_clauses(spark, d), ["article_id"], "text", V.MARKER_WORDS).groupBy("kind", "token", "negated").agg(F.count("*").alias("n"))


def marker_word_offsets(spark: SparkSession, d: str) -> DataFrame:
    m = L.morphology(L.tokens(_clauses(spark, d), ["article_id"], "text"), ["article_id"])
    return m.groupBy("article_id").agg(F.count("*").alias("n"), F.count_if("negated").alias("n_negated"), F.max("end").alias("last_end"))


def deontic_words(spark: SparkSession, d: str) -> DataFrame:
    return L.deontic(L.words(_clauses(spark, d), ["article_id"], "text", V.MARKER_WORDS)).groupBy("kind").agg(F.count("*").alias("n"))


def temporal_phrases(spark: SparkSession, d: str) -> DataFrame:
    return L.phrases(_clauses(spark, d), ["article_id"], "text").groupBy("kind", "phrase").agg(F.count("*").alias("n"))


def _unknown(spark: SparkSession, d: str) -> DataFrame:
    return L.listed_words(table(spark, d, "article_texts"), ["article_id"], "text", V.UNKNOWN_FORMS).withColumn("fingerprint", hashing.fnv1a64(F.col("token")))


def unknown_census(spark: SparkSession, d: str) -> DataFrame:
    return L.census(_unknown(spark, d), ["article_id"])


def unknown_ranked(spark: SparkSession, d: str) -> DataFrame:
    return L.ranked_census(_unknown(spark, d)).select("rank", "kind", "token", "n")


def unknown_unpatched(spark: SparkSession, d: str) -> DataFrame:
    forms = _unknown(spark, d)
    patched = forms.filter("token in ('часть', 'части')").select("kind", "fingerprint")
    return L.ranked_census(forms, patched).select("rank", "kind", "token", "n")


def block_markers(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ix", "line"))
    return lines.withColumn("m", L.marker(F.col("line"))).filter("m is not null").select("doc_id", "ix", "m.level", "m.number", F.md5("m.title").alias("title_md5"))


def owned_bodies(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ix", "line"))
    b = L.bodies(lines, ["doc_id"], "ix", F.col("line").rlike(r"^[0-9]+[.)] "), "line")
    return b.select("doc_id", "marker", F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"))


def depth_overflow(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "article_texts").filter("number is not null").select("article_id", F.lit("statya").alias("level"), tidy("number").alias("number"))
    return L.depth_overflows(a, {"statya": 1}).select("article_id", "number", "depth")


def proposed_membership(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "marker_bodies").filter("work_id is not null and edition_number is not null and order_index is not null")
    one = m.groupBy("work_id", "edition_number", "order_index").agg(F.min("marker_id").alias("marker_id"), F.min_by("marker_level", "marker_id").alias("marker_level"))
    rank = F.lit(None).cast("int")
    for i, lv in enumerate(V.LEVELS):
        rank = F.when(F.col("marker_level") == lv, i).otherwise(rank)
    p = propose(one, ["work_id", "edition_number"], "order_index", "marker_id", rank, len(V.LEVELS))
    return p.select("marker_id", F.coalesce("parent", F.lit(-1)).alias("parent"))


def unit_owners(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "open_blocks").filter("package_id is not null and order_index is not null").groupBy("package_id", "order_index").agg(F.min("text").alias("text"), F.min("kind").alias("kind"), F.min("block_id").alias("block_id"))
    o = L.unit_owners(m, ["package_id"], "order_index", F.coalesce(F.col("text").rlike("^[А-М]"), F.lit(False)), F.coalesce(F.col("kind") != "paragraph", F.lit(True)))
    return o.select("block_id", F.coalesce("owner", F.lit(-1)).alias("owner"))


def marker_levels(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "marker_bodies").select("marker_id", F.initcap("marker_level").alias("token"), "marker_level")
    pair = L.transition_error(F.lit("O0"), F.concat(F.lit("O"), (F.col("marker_id") % 3).cast("string")))
    return m.select("marker_id", F.coalesce(L.resolve_level(F.col("token")), F.lit("")).alias("level"), F.coalesce(L.resolve_level(F.concat("token", F.lit("x"))), F.lit("")).alias("none"), pair.alias("error"))


def group_probes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.coalesce("document_group", F.lit("")).alias("g"), F.explode(F.split("text", "\n")).alias("line"))
    p = L.structural_probe(docs, ["doc_id", "g"], "line", {"federal_law": "^Статья [0-9]", "government_resolution": "^[0-9]+[.] "})
    return p.select("doc_id", "n_federal_law", "n_government_resolution", L.two_factor(F.col("g"), {"federal_law": F.col("n_federal_law"), "government_resolution": F.col("n_government_resolution")}).alias("grp"))


_WSQL = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(8195)||chr(8201)||chr(8239)||chr(12288)"
_TOK = "SELECT {k}, unnest(regexp_extract_all(lower({t}), '\\p{{L}}+')) AS token FROM {f}"
_ART = _TOK.format(k="article_id", t="text", f="article_texts")
_UNKNOWN = "CASE " + " ".join(f"WHEN token IN ({_list(ws)}) THEN '{k}'" for k, ws in V.UNKNOWN_FORMS.items()) + " END"
_MARK = "CASE " + " ".join(f"WHEN token IN ({_list(ws)}) THEN '{k}'" for k, ws in V.MARKER_WORDS.items()) + " END"
_DEON = "CASE " + " ".join(f"WHEN token IN ({_list(V.MARKER_WORDS[k])}) THEN '{v}'" for k, v in V.DEONTIC.items()) + " END"
_IDERR = "CASE WHEN coalesce({c}, '') = '' THEN 'empty' WHEN strlen({c}) > {n} THEN 'too long' WHEN NOT regexp_full_match({c}, '[A-Za-z0-9_:.{x}-]+') THEN 'unsupported character' ELSE '' END"
_DAY = "CASE WHEN regexp_full_match(revision_date, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(revision_date AS DATE) END"
_NUMBER = "[0-9]+(?:\\.[0-9]+)*"

QUERIES = {f.__name__: f for f in (
    id_validation, minted_works, day_ordinals, dates_in_names, text_hashes, fingerprints, token_counts, token_offsets, sentence_counts, reference_mentions, marker_words, marker_word_offsets,
    deontic_words, temporal_phrases, unknown_census, unknown_ranked, unknown_unpatched, block_markers, owned_bodies, depth_overflow, proposed_membership,
    unit_owners, marker_levels, group_probes,
)}
_STY = "(SELECT * FROM open_blocks WHERE provider_style_id IS NULL OR provider_style_id NOT IN ('s9', 's9header'))"
_TEXTS = "(SELECT article_id, coalesce(text, '') || [" + ", ".join("'" + x.replace("'", "''") + "'" for x in CLAUSES) + f"][article_id % {len(CLAUSES)} + 1] AS text FROM article_texts)"
#: Runs of letters and of other characters in turn: list x, place i.
_PIECES = f"(SELECT article_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT article_id, regexp_extract_all(text, '\\p{{L}}+|[^\\p{{L}}]+') AS x FROM {_TEXTS}))"
_NEG = f"(i > 2 AND lower(x[greatest(i - 2, 1)]) = 'не' AND regexp_full_match(x[greatest(i - 1, 1)], '{L.SPACE}+'))"
_GAP = "regexp_full_match(coalesce(x[i + {k}], ''), '[ \\t]+')"
_ENTRY = f"lower(x[i]) IN ({_list(V.PHRASE_VERBS['enters_into_force'])}) AND lower(x[i + 2]) = 'в' AND lower(x[i + 4]) = 'силу' AND {_GAP.format(k=1)} AND {_GAP.format(k=3)}"
_LOSS = f"lower(x[i]) IN ({_list(V.PHRASE_VERBS['loses_force'])}) AND lower(x[i + 2]) = 'силу' AND {_GAP.format(k=1)}"
_MONTHS = "|".join(V.MONTHS)
_MONTH_NO = "CASE regexp_extract(l, '[0-9]{1,2}\\s+(" + _MONTHS + ")\\s+[0-9]{4}', 1) " + " ".join(f"WHEN '{m}' THEN '{k:02d}'" for m, k in V.MONTHS.items()) + " END"
ORACLES = {
    "id_validation": f"""SELECT coalesce(id, '') AS id, {_IDERR.format(c="id", n=64, x="")} AS error, {_IDERR.format(c="id", n=8, x="")} AS short_error,
      CASE WHEN {_IDERR.format(c="p", n=64, x="/")} <> '' THEN {_IDERR.format(c="p", n=64, x="/")} WHEN list_contains(string_split(p, '/'), '') THEN 'empty path segment' ELSE '' END AS path_error,
      CASE WHEN owner IS NULL THEN 1 ELSE len(list_filter(string_split(owner, '/'), lambda s: s <> '')) END AS depth FROM (SELECT *, concat_ws('/', id, owner) AS p FROM valid_items)""",
    "minted_works": f"""SELECT edition_number, coalesce(revision_date, '') AS day, CASE WHEN d IS NOT NULL THEN 'work:ru:federal:zakon:' || revision_date || ':' || edition_number || '-fz' ELSE '' END AS work,
      CASE WHEN d IS NULL THEN 'date' ELSE '' END AS error, CASE WHEN d IS NOT NULL THEN 'expr:ru:federal:zakon:' || revision_date || ':' || edition_number || '-fz:' || date_diff('day', DATE '1800-01-01', d) ELSE '' END AS expression,
      CASE WHEN d IS NOT NULL THEN 'urn:eli:ru/federal/zakon/' || revision_date || '/' || edition_number || '-fz' ELSE '' END AS urn FROM (SELECT DISTINCT edition_number, revision_date, {_DAY} AS d FROM edition_summaries)""",
    "day_ordinals": f"""SELECT edition_number, coalesce(revision_date, '') AS day, CAST(coalesce(CASE WHEN year(d) BETWEEN 1800 AND 2100 THEN date_diff('day', DATE '1800-01-01', d) END, -1) AS INT) AS ordinal,
      CASE WHEN revision_date IS NULL OR NOT regexp_full_match(revision_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'shape' WHEN d IS NULL THEN 'no such day' WHEN year(d) NOT BETWEEN 1800 AND 2100 THEN 'out of bounds' ELSE '' END AS error,
      coalesce(CASE WHEN year(d) BETWEEN 1800 AND 2100 THEN strftime(d, '%Y-%m-%d') END, '') AS back FROM (SELECT DISTINCT edition_number, revision_date, {_DAY} AS d FROM edition_summaries)""",
    "dates_in_names": f"""SELECT obs_id, coalesce(CASE WHEN regexp_matches(l, '[0-9]{{1,2}}\\s+({_MONTHS})\\s+[0-9]{{4}}') THEN regexp_extract(l, '[0-9]{{1,2}}\\s+({_MONTHS})\\s+([0-9]{{4}})', 2) || '-' || {_MONTH_NO} || '-' || lpad(regexp_extract(l, '([0-9]{{1,2}})\\s+({_MONTHS})\\s+[0-9]{{4}}', 1), 2, '0')
      WHEN regexp_matches(l, '[0-9]{{2}}[-.][0-9]{{2}}[-.][0-9]{{4}}') THEN regexp_extract(l, '([0-9]{{2}})[-.]([0-9]{{2}})[-.]([0-9]{{4}})', 3) || '-' || regexp_extract(l, '([0-9]{{2}})[-.]([0-9]{{2}})[-.]([0-9]{{4}})', 2) || '-' || regexp_extract(l, '([0-9]{{2}})[-.]([0-9]{{2}})[-.]([0-9]{{4}})', 1) END, '') AS day,
      coalesce(nullif(regexp_extract(l, '(?:^|[^\\p{{L}}])n\\s+([0-9]{{1,5}})', 1), ''), nullif(regexp_extract(l, '№\\s*([0-9]{{1,5}})', 1), ''), nullif(regexp_extract(l, 'pp_([0-9]{{1,5}})', 1), ''), '') AS act FROM (SELECT obs_id, lower(context_sample) AS l FROM observations)""",
    "text_hashes": "SELECT obs_id, sha256(link_text) AS sha, sha256(link_text || '|' || coalesce(context_sample, '') || '|' || coalesce(status, '')) AS digest FROM observations WHERE link_text IS NOT NULL",
    "token_counts": f"SELECT token, count(*) AS n, count(DISTINCT block_id) AS n_blocks FROM ({_TOK.format(k='block_id', t='text', f=_STY)}) GROUP BY token",
    "reference_mentions": f"""SELECT CASE WHEN regexp_extract(m, '^\\p{{L}}+') IN ({_list(V.ARTICLE_FORMS)}) THEN 'article' ELSE 'point' END AS kind, regexp_extract(m, '{_NUMBER}$') AS number, count(*) AS n
      FROM (SELECT unnest(regexp_extract_all(lower(text), '(?:^|[^\\p{{L}}])((?:{"|".join(sorted(V.ARTICLE_FORMS + V.POINT_FORMS, key=len, reverse=True))})[ \\t]+{_NUMBER})', 1)) AS m FROM article_texts) GROUP BY ALL""",
    "deontic_words": f"SELECT kind, count(*) AS n FROM (SELECT {_DEON} AS kind FROM (SELECT lower(x[i]) AS token FROM {_PIECES})) WHERE kind IS NOT NULL GROUP BY kind",
    "marker_words": f"SELECT kind, token, negated, count(*) AS n FROM (SELECT token, negated, {_MARK} AS kind FROM (SELECT lower(x[i]) AS token, {_NEG} AS negated FROM {_PIECES})) WHERE kind IS NOT NULL GROUP BY ALL",
    "marker_word_offsets": f"SELECT article_id, count(*) AS n, count(*) FILTER (negated) AS n_negated, max(last_end) AS last_end FROM (SELECT article_id, negated, last_end, {_MARK} AS kind FROM (SELECT article_id, lower(x[i]) AS token, {_NEG} AS negated, strlen(array_to_string(x[1:i], '')) AS last_end FROM {_PIECES})) WHERE kind IS NOT NULL GROUP BY 1",
    "temporal_phrases": f"SELECT kind, phrase, count(*) AS n FROM (SELECT CASE WHEN {_ENTRY} THEN 'enters_into_force' ELSE 'loses_force' END AS kind, array_to_string(x[i:i + CASE WHEN {_ENTRY} THEN 4 ELSE 2 END], '') AS phrase FROM {_PIECES} WHERE ({_ENTRY}) OR ({_LOSS})) GROUP BY ALL",
    "token_offsets": f"SELECT block_id, len(list_filter(x, lambda p: regexp_matches(p, '\\p{{L}}'))) AS n, strlen(array_to_string(x, '')) - CASE WHEN regexp_matches(x[-1], '\\p{{L}}') THEN 0 ELSE strlen(x[-1]) END AS last_end, list_sum(list_transform(list_filter(x, lambda p: regexp_matches(p, '\\p{{L}}')), lambda p: strlen(p)))::bigint AS n_bytes FROM (SELECT block_id, regexp_extract_all(text, '\\p{{L}}+|[^\\p{{L}}]+') AS x FROM {_STY}) WHERE len(list_filter(x, lambda p: regexp_matches(p, '\\p{{L}}'))) > 0",
    "fingerprints": "SELECT DISTINCT link_text, 'fnv1a64:' || lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(0, strlen(link_text)), lambda i: ('0x' || substr(hex(encode(link_text)), 2 * i + 1, 2))::int::hugeint)), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint)), 16, '0') AS fingerprint FROM observations WHERE link_text IS NOT NULL",
    "block_markers": f"""WITH b AS (SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int AS ix, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), g AS (SELECT *, regexp_extract(line, '{L.marker_pattern()}', ['g1', 'g2', 'g3', 'g4', 'g5', 'g6', 'g7', 'g8']) AS g FROM b WHERE regexp_matches(line, '{L.marker_pattern()}'))
      SELECT doc_id, ix, CASE WHEN lower(g.g1) <> '' THEN CASE WHEN lower(g.g1) = 'раздел' THEN 'razdel' ELSE 'glava' END WHEN g.g3 <> '' THEN 'statya' WHEN g.g5 <> '' THEN 'paragraph' WHEN g.g7 = '.' THEN 'chast' ELSE 'punkt' END AS level, g.g2 || g.g4 || g.g5 || g.g6 AS number,
      md5(regexp_replace(g.g8, '^{L.SPACE}+|{L.SPACE}+$', '', 'g')) AS title_md5 FROM g""",
    "unknown_census": "SELECT article_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in V.UNKNOWN_FORMS) + f" FROM (SELECT article_id, {_UNKNOWN} AS kind FROM ({_ART})) WHERE kind IS NOT NULL GROUP BY 1",
    "unknown_ranked": f"SELECT row_number() OVER (ORDER BY count(*) DESC, token, kind)::int AS rank, kind, token, count(*) AS n FROM (SELECT token, {_UNKNOWN} AS kind FROM ({_ART})) WHERE kind IS NOT NULL GROUP BY kind, token",
    "unknown_unpatched": f"SELECT row_number() OVER (ORDER BY count(*) DESC, token, kind)::int AS rank, kind, token, count(*) AS n FROM (SELECT token, {_UNKNOWN} AS kind FROM ({_ART})) WHERE kind IS NOT NULL AND token NOT IN ('часть', 'части') GROUP BY kind, token",
    "owned_bodies": """WITH b AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ix, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
      o AS (SELECT *, regexp_matches(line, '^[0-9]+[.)] ') AS m, max(CASE WHEN regexp_matches(line, '^[0-9]+[.)] ') THEN ix END) OVER (PARTITION BY doc_id ORDER BY ix) AS marker FROM b),
      s AS (SELECT doc_id, marker, coalesce(string_agg(trim(line, ' '), chr(10) ORDER BY ix) FILTER (NOT m AND trim(line, ' ') <> ''), '') AS body FROM o WHERE marker IS NOT NULL GROUP BY 1, 2)
      SELECT doc_id, CAST(marker AS INT) AS marker, CAST(length(body) AS INT) AS n_chars, md5(body) AS body_md5 FROM s""",
    "depth_overflow": f"SELECT article_id, n AS number, CAST(len(string_split(n, '.')) AS INT) AS depth FROM (SELECT article_id, trim(number, {_WSQL}) AS n FROM article_texts WHERE number IS NOT NULL) WHERE len(string_split(n, '.')) > 1",
    "proposed_membership": f"""WITH one AS (SELECT work_id, edition_number, order_index, min(marker_id) AS marker_id, arg_min(marker_level, marker_id) AS lv FROM marker_bodies WHERE work_id IS NOT NULL AND edition_number IS NOT NULL AND order_index IS NOT NULL GROUP BY 1, 2, 3),
      r AS (SELECT *, list_position([{_list(V.LEVELS)}], lv) AS rk FROM one WHERE list_position([{_list(V.LEVELS)}], lv) > 0)
      SELECT marker_id, coalesce((SELECT arg_max(b.marker_id, b.order_index) FROM r b WHERE b.work_id = a.work_id AND b.edition_number = a.edition_number AND b.order_index < a.order_index AND b.rk < a.rk), -1) AS parent FROM r a""",
    "unit_owners": """WITH m AS (SELECT package_id, order_index, min(text) AS text, min(kind) AS kind, min(block_id) AS block_id FROM open_blocks WHERE package_id IS NOT NULL AND order_index IS NOT NULL GROUP BY 1, 2),
      e AS (SELECT *, CASE WHEN coalesce(kind <> 'paragraph', true) THEN -1 WHEN regexp_matches(coalesce(text, ''), '^[А-М]') THEN order_index END AS ev FROM m),
      o AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY package_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e)
      SELECT block_id, CASE WHEN ev IS NULL AND b >= 0 THEN b ELSE -1 END AS owner FROM o""",
    "marker_levels": f"SELECT marker_id, CASE WHEN marker_level IN ({_list(V.LEVELS)}) THEN marker_level ELSE '' END AS level, '' AS none, CASE WHEN marker_id % 3 = 1 THEN '' ELSE 'unknown transition' END AS error FROM marker_bodies",
    "group_probes": """WITH l AS (SELECT doc_id, coalesce(document_group, '') AS g, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
      p AS (SELECT doc_id, g, count(*) FILTER (regexp_matches(line, '^Статья [0-9]')) AS n_federal_law, count(*) FILTER (regexp_matches(line, '^[0-9]+[.] ')) AS n_government_resolution FROM l GROUP BY 1, 2)
      SELECT doc_id, n_federal_law, n_government_resolution, CASE WHEN g = 'federal_law' THEN CASE WHEN n_federal_law > 0 THEN g ELSE 'unknown' END WHEN g = 'government_resolution' THEN CASE WHEN n_government_resolution > 0 THEN g ELSE 'unknown' END
      WHEN g = '' THEN 'unknown' ELSE g END AS grp FROM p""",
}
