"""Queries for the parser's functions and operators, each with SQL.

The driver's tables hold no résumés, so lines are derived from orders and parts: a customer
is a document, and each of its orders is a line whose kind its number decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as X
from ..operators import layout, ranking, resume, segment, store
from .catalogue import _t, query

# --- SQL of common steps -----------------------------------------------------------------

_DATES = X.DATE
_WHOLE = f"(?i){_DATES}{X.RANGE_DASH}(?:{_DATES}|{X.PRESENT})"
_PAIR = f"(?i)({_DATES}){X.RANGE_DASH}({_DATES}|{X.PRESENT})"
_GENERIC = ", ".join(f"'{o}'" for o in X.GENERIC_ORGS)


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _words(c: str) -> str:
    return f"len(list_filter(string_split_regex({_strip(c)}, '\\s+'), lambda w: w != ''))"


def _edges(c: str) -> str:
    return f"regexp_replace({c}, '^[ \\t\\-—–:,.]+|[ \\t\\-—–:,.]+$', '', 'g')"


def _undated(c: str) -> str:
    out = f"regexp_replace(regexp_replace({c}, '{_WHOLE}', '', 'g'), '(?i){_DATES}', '', 'g')"
    return _edges(_strip(f"regexp_replace(regexp_replace({out}, '{X.RANGE_DASH}', ' ', 'g'), '\\s+', ' ', 'g')"))


def _bare(c: str, glyphs: str = X.BULLETS) -> str:
    return f"regexp_replace({c}, '^\\s*[{glyphs}]\\s*', '')"


def _org_shape(c: str) -> str:
    s = _strip(c)
    return f"""coalesce({s} != '' AND length({s}) <= 20 AND lower({s}) NOT IN ({_GENERIC}) AND upper(left({s}, 1)) = left({s}, 1)
      AND lower(left({s}, 1)) != left({s}, 1) AND ({_words(s)} = 1 OR ({_words(s)} <= 2 AND contains({s}, '.'))), false)"""


def _org_hit(line: str, orgs: str) -> str:
    return f"list_filter({orgs}, lambda o: length(o) > 3 AND lower(o) NOT IN ({_GENERIC}) AND regexp_matches(lower({line}), '\\b' || lower(o) || '\\b'))[1]"


def _residue(c: str) -> str:
    return f"coalesce({c} IS NULL OR length({_strip(c)}) <= 3 OR lower({_strip(c)}) IN ({_GENERIC}), true)"


def _end(c: str) -> str:
    return f"CASE WHEN regexp_matches(lower({_strip(c)}), '(?i)^(?:{X.PRESENT})') THEN 'present' ELSE {_strip(c)} END"


def _split(keys: str, lines: str) -> str:
    """CTEs ending in ``items`` (keys, i, item). The depth of brackets that never falls under
    zero is the plain sum less its lowest value so far."""
    return f"""
ch AS (SELECT {keys}, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS p FROM {lines}),
plain AS (SELECT *, sum(CASE WHEN ch IN ('(', '[', '{{') THEN 1 WHEN ch IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY p) AS s FROM ch),
depth AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY {keys} ORDER BY p)) AS depth FROM plain),
cuts AS (SELECT *, ch IN (',', ';', '|') AND depth = 0 AS cut FROM depth),
numbered AS (SELECT *, sum(cut::INT) OVER (PARTITION BY {keys} ORDER BY p) AS n FROM cuts),
whole AS (SELECT {keys}, n, string_agg(ch, '' ORDER BY p) AS item FROM numbered WHERE NOT cut GROUP BY {keys}, n),
lists AS (SELECT *, CASE WHEN contains(item, '  ') THEN string_split_regex(item, '\\s*[,;|]\\s*|\\s{{2,}}') ELSE [item] END AS parts FROM whole),
flat AS (SELECT {keys}, n, unnest(parts) AS item, generate_subscripts(parts, 1) AS j FROM lists),
items AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY n, j) - 1)::INT AS i, regexp_replace({_strip('item')}, '^\\.+|\\.+$', '', 'g') AS item FROM flat WHERE {_strip('item')} != '')"""


def _noise(c: str) -> str:
    has = " OR ".join(f"contains(lower({c}), '{p}')" for p in X.SKILL_CONTACTS)
    return f"(length({c}) < 2 OR length({c}) > 60 OR regexp_matches({c}, '^(19|20)\\d{{2}}$') OR regexp_matches({c}, '^\\d{{2,}}[\\s\\-./]*\\d*$') OR lower({_strip(c)}) IN ({_quoted(X.SKILL_STOPS)}) OR {has})"


def _payload(c: str) -> str:
    s = _bare(_strip(c), X.SKILL_BULLETS)
    return f"coalesce(nullif(regexp_extract({s}, '^\\s*([\\w\\s&/+\\-.]{{2,50}})\\s*[:：]\\s*(.+)$', 2), ''), {s})"


# --- derived texts, by expressions that both engines know -----------------------------------

_DAY = "substr(cast(o_orderdate AS string), 6, 2) || '/' || substr(cast(o_orderdate AS string), 1, 4)"
_JOB_LINE = f"""CASE o_orderkey % 9 WHEN 0 THEN 'Globex ' || {_DAY} || ' - Present' WHEN 1 THEN 'Data Engineer 2015 – 2017' WHEN 2 THEN '• built things'
 WHEN 3 THEN 'Initech' WHEN 4 THEN 'Senior Developer at Astana Hub, Mar 2016 - now' WHEN 5 THEN '  Backend developer' WHEN 6 THEN 'AI 2014' WHEN 7 THEN '2012 → 2013' ELSE 'Astana Hub: 2011' END"""
_SCHOOL_LINE = f"""CASE o_orderkey % 7 WHEN 0 THEN 'BSc Computer Science, Nazarbayev University, 2012 - 2016' WHEN 1 THEN 'City College' WHEN 2 THEN '- thesis on graphs'
 WHEN 3 THEN 'Master of Science ' || {_DAY} WHEN 4 THEN 'Studied at Nazarbayev University' WHEN 5 THEN 'A school with a deep study of physics and mathematics' ELSE '2010 — 2011: course' END"""
_SKILL_LINE = """CASE o_orderkey % 6 WHEN 0 THEN '• Tools: Git, Docker (Compose, Swarm); Kafka | SQL' WHEN 1 THEN 'Python  Spark  and  Scala, ' || o_orderpriority
 WHEN 2 THEN 'open) now, R (a, [b, c' WHEN 3 THEN 'mail me: x@y.com, 2019, 12-34, git' WHEN 4 THEN ' ;, | ' ELSE 'Soft/Team: talks., ' || o_orderstatus || 'X, ...Go' END"""
_ORGS = "CASE WHEN o_custkey % 2 = 0 THEN {0}'AI', 'Initech', 'Astana Hub', 'Nazarbayev University'{1} ELSE {0}'Astana Hub'{1} END"
_NAME_LINE = "CASE o_orderkey % 5 WHEN 0 THEN 'Curriculum' WHEN 1 THEN ' Ivan Petrov ' WHEN 2 THEN 'JOHN MC SMITH' WHEN 3 THEN 'Anna-Maria Lee' ELSE 'Ann lee' END"


def _lines(spark, d, text: str, section: str) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.expr(text).alias("text"), F.lit(section).alias("section"))


def _orgs(spark, d) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.expr(_ORGS.format("array(", ")")).alias("orgs")).distinct()


_ORDER_LINES = "SELECT o_custkey AS doc_id, o_orderkey AS line_no, {} AS text, " + _ORGS.format("[", "]") + " AS orgs FROM orders"


# --- functions -------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, {_undated(f'({_JOB_LINE})')} AS bare FROM orders")
def strip_dates(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", X.without_dates(F.expr(_JOB_LINE)).alias("bare"))


_TWO = f"({_JOB_LINE}) || '; ' || ({_SCHOOL_LINE})"


@query(f"""WITH t AS (SELECT o_orderkey, {_TWO} AS line FROM orders),
r AS (SELECT o_orderkey, list_transform(regexp_extract_all(line, '{_WHOLE}'), lambda m: {_strip(f"regexp_extract(m, '{_PAIR}', 1)")} || '>' || {_end(f"regexp_extract(m, '{_PAIR}', 2)")}) AS ranges,
  list_transform(regexp_extract_all(regexp_replace(line, '{_WHOLE}', '#', 'g'), '(?i){_DATES}'), lambda m: '>' || m) AS singles FROM t)
SELECT o_orderkey, array_to_string(list_concat(ranges, singles), ';') AS dates FROM r""")
def date_ranges_all(spark, d):
    """Every range of a line, then its single dates."""
    found = F.transform(X.date_ranges(F.expr(_TWO)), lambda x: F.concat(F.coalesce(x["start"], F.lit("")), F.lit(">"), x["end"]))
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(found, ";").alias("dates"))


@query(f"""WITH t AS (SELECT o_orderkey, {_TWO} AS line FROM orders),
r AS (SELECT o_orderkey, list_transform(regexp_extract_all(line, '{_WHOLE}'), lambda m: [{_strip(f"regexp_extract(m, '{_PAIR}', 1)")}, {_end(f"regexp_extract(m, '{_PAIR}', 2)")}]) AS ranges,
  list_transform(regexp_extract_all(regexp_replace(line, '{_WHOLE}', '#', 'g'), '(?i){_DATES}'), lambda m: [NULL, m]) AS singles FROM t),
e AS (SELECT o_orderkey, generate_subscripts(list_concat(ranges, singles), 1) AS i, unnest(list_concat(ranges, singles)) AS p FROM r)
SELECT o_orderkey, (i - 1)::INT AS pos, p[1] AS start_date, p[2] AS end_date FROM e""")
def date_ranges_sql(spark, d):
    """The same by a table function in SQL text."""
    tables.register(spark)
    _t(spark, d, "orders").select("o_orderkey", F.expr(_TWO).alias("line")).createOrReplaceTempView("rankspark_dated_lines")
    return spark.sql("SELECT o_orderkey, d.pos, d.start AS start_date, d.end AS end_date FROM rankspark_dated_lines, LATERAL date_ranges(line) d")


_ENDS = "CASE o_orderkey % 5 WHEN 0 THEN ' Present' WHEN 1 THEN 'CURRENT  time ' WHEN 2 THEN 'currently' WHEN 3 THEN 'nowhere' ELSE ' 2019 ' END"


@query(f"SELECT o_orderkey, {_end(f'({_ENDS})')} AS end_date FROM orders")
def normalised_ends(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", X.normalised_end(F.expr(_ENDS)).alias("end_date"))


_ORG_TEXT = "CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN p_name WHEN 2 THEN 'Node.js ' || p_type WHEN 3 THEN 'AI' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE ' ' || p_type || ' ' END"


@query(f"SELECT p_partkey, {_org_shape(f'({_ORG_TEXT})')} AS is_org, {_residue(f'({_ORG_TEXT})')} AS is_residue FROM part")
def org_shapes(spark, d):
    """Texts shaped like an organisation, and residues that are no role."""
    return _t(spark, d, "part").select("p_partkey", X.looks_like_org(F.expr(_ORG_TEXT)).alias("is_org"), X.is_residue(F.expr(_ORG_TEXT)).alias("is_residue"))


_WORKS = "CASE s_suppkey % 4 WHEN 0 THEN 'AI lead, ' || n_name WHEN 1 THEN 'X' || n_name || ' in ' || r_name WHEN 2 THEN lower(n_name) || ', ' || r_name ELSE 'nothing' END"


@query(f"""WITH t AS (SELECT s_suppkey, {_WORKS} AS line, ['AI', n_name, r_name] AS orgs FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, {_org_hit('line', 'orgs')} AS org FROM t""")
def orgs_in_lines(spark, d):
    at = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return at.select("s_suppkey", X.org_in_line(F.expr(_WORKS), F.array(F.lit("AI"), "n_name", "r_name")).alias("org"))


@query(f"SELECT o_orderkey, {_bare(f'({_SCHOOL_LINE})')} AS bare, {_bare(f'({_SCHOOL_LINE})')} != ({_SCHOOL_LINE}) AS bullet, {_payload(f'({_SKILL_LINE})')} AS payload FROM orders")
def bullet_lines(spark, d):
    """Lines without their bullets, and skill lines without their category."""
    line = F.expr(_SCHOOL_LINE)
    return _t(spark, d, "orders").select("o_orderkey", X.without_bullet(line).alias("bare"), X.is_bullet(line).alias("bullet"), X.skill_payload(F.expr(_SKILL_LINE)).alias("payload"))


@query(f"WITH l AS (SELECT event_id, {_payload('props')} AS text FROM events), {_split('event_id', 'l')} SELECT * FROM items WHERE NOT {_noise('item')}")
def skills_split(spark, d):
    """Items of event properties, split outside brackets, without noise."""
    at = _t(spark, d, "events").select("event_id", F.posexplode(X.split_items(X.skill_payload(F.col("props")))).alias("i", "item"))
    return at.where(~X.is_skill_noise(F.col("item")))


@query(f"WITH l AS (SELECT o_orderkey, {_payload(f'({_SKILL_LINE})')} AS text FROM orders), {_split('o_orderkey', 'l')} SELECT *, {_noise('item')} AS noise FROM items")
def skill_items(spark, d):
    """Items of lines with nested and unbalanced brackets, and which of them are noise."""
    at = _t(spark, d, "orders").select("o_orderkey", F.posexplode(X.split_items(X.skill_payload(F.expr(_SKILL_LINE)))).alias("i", "item"))
    return at.withColumn("noise", X.is_skill_noise(F.col("item")))


@query(f"WITH l AS (SELECT o_orderkey, {_payload(f'({_SKILL_LINE})')} AS text FROM orders), {_split('o_orderkey', 'l')} SELECT *, {_noise('item')} AS noise FROM items")
def skill_items_sql(spark, d):
    """The same by a table function in SQL text."""
    tables.register(spark)
    _t(spark, d, "orders").select("o_orderkey", F.expr(_SKILL_LINE).alias("line")).createOrReplaceTempView("rankspark_skill_lines")
    return spark.sql("SELECT o_orderkey, s.pos AS i, s.item, s.noise FROM rankspark_skill_lines, LATERAL skill_items(line) s")


_PHRASE = "CASE p_partkey % 8 WHEN 0 THEN 'developed' WHEN 1 THEN p_name WHEN 2 THEN '12.03 ' || p_name WHEN 3 THEN '' || p_size WHEN 4 THEN '77 123 ' || p_name WHEN 5 THEN p_name || '.com' WHEN 6 THEN 'ab' ELSE 'www ' || p_type END"
_PHRASE_HAS = " OR ".join(f"contains(lower(p), '{x}')" for x in X.PHRASE_CONTACTS)


@query(f"""SELECT p_partkey, length(p) <= 2 OR regexp_matches(p, '^\\d+$') OR regexp_matches(p, '\\d{{2}}[.\\-/]\\d{{2}}') OR regexp_matches(p, '\\d{{2,}}\\s+\\d{{2,}}')
  OR lower(p) IN ({_quoted(X.PHRASE_VERBS)}) OR {_PHRASE_HAS} AS junk FROM (SELECT p_partkey, {_strip(f'({_PHRASE})')} AS p FROM part)""")
def junk_phrases(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.is_junk_phrase(F.expr(_PHRASE)).alias("junk"))


_OF_NAME = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type || ' ' || p_name WHEN 2 THEN p_type || ' x ' || split_part(p_name, ' ', 1) ELSE p_type END"
_NAMED = "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'X ' || upper(p_name) END"


@query(f"""WITH t AS (SELECT p_partkey, list_filter(string_split(lower({_NAMED}), ' '), lambda x: length(x) > 1) AS names, string_split(lower({_OF_NAME}), ' ') AS parts FROM part)
SELECT p_partkey, coalesce(len(names) > 0 AND len(list_filter(parts, lambda x: list_contains(names, x))) / len(parts) >= 0.5, false) AS dominated FROM t""")
def dominated_phrases(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.dominated_by(F.expr(_OF_NAME), F.expr(_NAMED)).alias("dominated"))


_TITLE = "CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END"


@query(f"SELECT p_partkey, CASE WHEN coalesce({_TITLE}, '') != '' THEN {_TITLE} || chr(10) || chr(10) || p_type ELSE p_type END AS text FROM part")
def vacancy_texts(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.vacancy_text(F.expr(_TITLE), F.col("p_type")).alias("text"))


@query("""WITH b AS (SELECT page_id, regexp_replace(replace(trim(regexp_extract(url, '([^/]+)/*$', 1)), ' ', '_'), '[^\\p{L}\\p{N}_.\\-]+', '_', 'g') AS c FROM pages),
s AS (SELECT page_id, coalesce(nullif(c, ''), 'uploaded.bin') AS c, regexp_extract(coalesce(nullif(c, ''), 'uploaded.bin'), '^.+(\\.[^.]+)$', 1) AS s FROM b)
SELECT page_id, page_id || '_' || substr(c, 1, length(c) - length(s)) || lower(s) AS name, true AS temporary FROM s""")
def final_names(spark, d):
    """Names of stored uploads; temporary ones have a random part of eight hex digits."""
    url = F.col("url")
    shaped = F.regexp_like(X.temp_name(url), F.lit("^_tmp_[0-9a-f]{8}_.+$"))
    return _t(spark, d, "pages").select("page_id", X.final_name(F.col("page_id"), url).alias("name"), shaped.alias("temporary"))


_CAPTION = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name WHEN 2 THEN upper(p_name || ' a b c d e') ELSE repeat(p_name || ' ', 5) END"


@query(f"""SELECT p_partkey, t != '' AND length(t) <= 40 AND (p_size >= 26.0 OR p_partkey % 5 = 0 OR (upper(t) = t AND lower(t) != t AND {_words('t')} <= 5)) AS header
FROM (SELECT p_partkey, p_size, {_strip(f'({_CAPTION})')} AS t FROM part)""")
def header_candidates(spark, d):
    """Lines that may be headers: short, and large, bold or in capitals."""
    return _t(spark, d, "part").select("p_partkey", segment.may_be_header(F.expr(_CAPTION), F.col("p_size"), F.col("p_partkey") % 5 == 0, F.lit(25.0)).alias("header"))


@query("""WITH RECURSIVE p AS (SELECT n_name, r_name, lower(n_name) AS a, lower(r_name) AS b FROM nation JOIN region ON n_regionkey = r_regionkey),
dp AS (SELECT *, 0::BIGINT AS i, list_transform(range(0, length(b) + 1), lambda j: 0::BIGINT) AS lcs FROM p
  UNION ALL SELECT n_name, r_name, a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k:
    CASE WHEN k = 0 THEN 0::BIGINT ELSE greatest(lcs[k + 1], lcs[k] + (substr(a, i + 1, 1) = substr(b, k, 1))::BIGINT) END))) FROM dp WHERE i < length(a))
SELECT n_name, r_name, round(200.0::DOUBLE * lcs[length(b) + 1] / (length(a) + length(b)), 6) AS ratio FROM dp WHERE i = length(a)""")
def fuzzy_indel(spark, d):
    at = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return at.select("n_name", "r_name", F.round(segment.indel(F.lower("n_name"), F.lower("r_name")), 6).alias("ratio"))


def _part(name: str, c: str) -> str:
    return f"'{name}: ' || coalesce(nullif({c}, ''), '(none)')"


_ROLE = "CASE WHEN o_orderstatus != 'P' THEN o_orderpriority END"
_UNTIL = "CASE WHEN o_orderstatus != 'O' THEN '' || o_orderkey END"


@query(f"""WITH o AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS skills,
  list('- ' || coalesce({_ROLE}, '?') || ' @ C' || o_custkey || ' (' || 'S' || o_orderkey || ' - ' || coalesce({_UNTIL}, '?') || ')' ORDER BY o_orderkey) AS jobs,
  list('- ' || coalesce({_ROLE}, '?') || ' @ ?' ORDER BY o_orderkey) AS schools FROM orders GROUP BY 1),
c AS (SELECT c_custkey, c_mktsegment, c_name, skills, jobs, schools, repeat(c_name, (c_custkey % 400)::INT) AS raw FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, concat_ws(chr(10), {_part('title', 'c_mktsegment')}, {_part('description', 'c_name')}, {_part('skills', "array_to_string(skills[1:30], '; ')")},
  {_part('experience', "array_to_string(jobs[1:5], chr(10))")}, {_part('education', "array_to_string(schools[1:3], chr(10))")},
  {_part('text', "CASE WHEN length(raw) > 4000 THEN substr(raw, 1, 4000) || '… [truncated]' ELSE raw END")}) AS prompt FROM c""")
def scorer_prompts(spark, d):
    """What a scorer reads of a customer, whose orders stand for jobs and schools."""
    entry = F.struct("o_orderkey", F.expr(_ROLE).alias("role"), F.concat(F.lit("C"), "o_custkey").alias("organization"), F.concat(F.lit("S"), "o_orderkey").alias("start"), F.expr(_UNTIL).alias("end"), F.expr(_ROLE).alias("degree"), F.lit(None).cast("string").alias("institution"))
    held = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("skills"), F.sort_array(F.collect_list(entry)).alias("entries"))
    at = _t(spark, d, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left")
    parsed = F.struct("skills", F.col("entries").alias("experience"), F.col("entries").alias("education"))
    raw = F.repeat("c_name", (F.col("c_custkey") % 400).cast("int"))
    return at.select("c_custkey", X.prompt(F.col("c_mktsegment"), F.col("c_name"), parsed, raw).alias("prompt"))


# --- operators on lines and words -------------------------------------------------------------


def _anchors(line: str) -> str:
    """CTEs ending in ``marked``: lines with dates, bullets, organisations and blocks."""
    return f"""l AS ({_ORDER_LINES.format(f"{_strip(f'({line})')}")}),
dated AS (SELECT *, regexp_matches(text, '(?i){_DATES}') AS anchor, regexp_matches(text, '{_PAIR}') AS ranged, nullif({_undated('text')}, '') AS left_, {_strip(_bare('text'))} AS bare, {_org_hit('text', 'orgs')} AS hit FROM l),
marked AS (SELECT *, bare != text AS bullet, {_words('bare')} AS n, nullif(CASE WHEN ranged THEN regexp_extract(text, '{_PAIR}', 1) END, '') AS start_, CASE WHEN ranged THEN {_end(f"regexp_extract(text, '{_PAIR}', 2)")} WHEN anchor THEN regexp_extract(text, '(?i){_DATES}') END AS end_,
  sum(anchor::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS block FROM dated)"""


_BEFORE = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_RAW = "max(start_) AS start_date, max(end_) AS end_date, substr(string_agg(text, chr(10) ORDER BY line_no), 1, 600) AS raw"
_ENTRY = ["start AS start_date", "end AS end_date", "raw"]


@query(f"""WITH {_anchors(_JOB_LINE)},
own AS (SELECT *, anchor AND {_org_shape('left_')} AS shaped, anchor AND coalesce(lower(left_) = lower(hit), false) AS named FROM marked),
sets AS (SELECT *, CASE WHEN shaped THEN left_ WHEN named THEN hit WHEN NOT anchor AND block = 0 AND NOT bullet AND n <= 4 THEN bare END AS sets FROM own),
org AS (SELECT *, CASE WHEN NOT anchor THEN NULL WHEN shaped OR named THEN sets ELSE coalesce(last_value(sets IGNORE NULLS) {_BEFORE}, hit) END AS org FROM sets),
role AS (SELECT *, CASE WHEN NOT anchor OR shaped OR named THEN NULL WHEN contains(lower(left_), lower(org)) THEN nullif({_edges("regexp_replace(left_, '(?i)' || regexp_escape(org), '', 'g')")}, '') ELSE left_ END AS role FROM org)
SELECT doc_id, block, max(org) AS organization, coalesce(max(CASE WHEN NOT {_residue('role')} THEN role END), arg_min(bare, line_no) FILTER (NOT anchor AND NOT bullet AND n BETWEEN 1 AND 6)) AS role, {_RAW}
FROM role WHERE block > 0 GROUP BY 1, 2""")
def experience_blocks(spark, d):
    """Jobs of dated lines: organisation, role, dates and text."""
    return resume.experience(_lines(spark, d, _JOB_LINE, "experience"), _orgs(spark, d)).selectExpr("doc_id", "block", "organization", "role", *_ENTRY)


@query(f"""WITH {_anchors(_SCHOOL_LINE)},
named AS (SELECT *, CASE WHEN block = 0 AND NOT bullet AND n <= 6 THEN bare END AS named FROM marked),
inst AS (SELECT *, CASE WHEN anchor THEN coalesce(hit, CASE WHEN block = 1 THEN last_value(named IGNORE NULLS) {_BEFORE} END) END AS inst FROM named),
degree AS (SELECT *, CASE WHEN anchor THEN nullif({_edges(_strip("regexp_replace(CASE WHEN inst IS NULL THEN coalesce(left_, '') ELSE regexp_replace(coalesce(left_, ''), '(?i)' || regexp_escape(inst), '', 'g') END, '\\s+', ' ', 'g')"))}, '') END AS degree FROM inst)
SELECT doc_id, block, coalesce(max(inst), arg_min(hit, line_no) FILTER (NOT anchor AND hit IS NOT NULL)) AS institution, max(degree) AS degree, {_RAW} FROM degree WHERE block > 0 GROUP BY 1, 2""")
def education_blocks(spark, d):
    """Schools of dated lines: institution, degree, dates and text."""
    return resume.education(_lines(spark, d, _SCHOOL_LINE, "education"), _orgs(spark, d)).selectExpr("doc_id", "block", "institution", "degree", *_ENTRY)


_DISTINCT_SKILLS = f"""first AS (SELECT doc_id, lower(item) AS k, min(line_no * 1000 + i) AS place, arg_min(item, line_no * 1000 + i) AS skill FROM items WHERE NOT {_noise('item')} GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place)::INT AS pos, skill FROM first"""


@query(f"WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_payload(f'({_SKILL_LINE})')} AS text FROM orders), {_split('doc_id, line_no', 'l')}, {_DISTINCT_SKILLS}")
def skill_sections(spark, d):
    """Skills of a document, the first of each spelling, in order."""
    return resume.skills(_lines(spark, d, _SKILL_LINE, "skills"))


@query(f"""WITH l AS (SELECT user_id AS doc_id, event_id AS line_no, {_payload("event_type || ', ' || translate(props, '{{}}\":', '    ')")} AS text FROM events), {_split('doc_id, line_no', 'l')}, {_DISTINCT_SKILLS}""".replace("{{}}", "{}"))
def skill_lines(spark, d):
    lines = _t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), F.concat("event_type", F.lit(", "), F.translate("props", '{}":', "    ")).alias("text"), F.lit("skills").alias("section"))
    return resume.skills(lines)


@query(f"""WITH l AS (SELECT o_custkey AS doc_id, {_strip(f'({_NAME_LINE})')} AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), t AS (SELECT *, string_split(text, ' ') AS t FROM l WHERE n <= 3)
SELECT doc_id, arg_min(text, n) AS name FROM t WHERE len(t) BETWEEN 2 AND 3 AND list_bool_and(list_transform(t, lambda x: length(x) >= 2))
  AND (list_bool_and(list_transform(t, lambda x: regexp_matches(x, '{X.NAME_CAPITAL}'))) OR list_bool_and(list_transform(t, lambda x: regexp_matches(x, '{X.NAME_CAPS}')))) GROUP BY 1""")
def first_names(spark, d):
    """The first valid name of a document's first three lines."""
    return resume.names(_lines(spark, d, _NAME_LINE, "about"))


@query("SELECT conv_id AS doc_id, CASE role WHEN 'user' THEN 'experience' WHEN 'system' THEN 'education' ELSE 'skills' END AS section, count(*) AS lines FROM conversations GROUP BY 1, 2")
def parse_conversations(spark, d):
    """Conversations as documents: a turn's role is its section's header line."""
    at = _t(spark, d, "conversations")
    head = F.when(F.col("role") == "user", "Experience").when(F.col("role") == "system", "Education").otherwise("Skills")
    rows = at.select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.array(F.upper(head), "text")).alias("i", "text"))
    lines = rows.select("doc_id", (F.col("turn") * 2 + F.col("i")).alias("line_no"), "text", F.lit(10.0).alias("max_font_size"), F.lit(False).alias("is_bold"))
    return segment.sections(lines).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"))


# words of pages: a supplier's items, two thirds of which stand in two columns
_X0 = "CASE WHEN l_orderkey % 3 = 0 THEN (l_partkey * 37 + l_orderkey * 11) % 580 WHEN l_orderkey % 3 = 1 OR l_suppkey % 2 = 0 THEN 50 + (l_partkey * 37) % 60 ELSE 350 + (l_partkey * 37) % 60 END"
_WORDS = f"SELECT l_suppkey AS doc_id, l_linenumber AS page, l_orderkey AS seq, 'w' || l_partkey AS text, CAST({_X0} AS DOUBLE) AS x0, (l_orderkey % 40) * CAST(2.5 AS DOUBLE) AS top, CAST(600 AS DOUBLE) AS page_width, l_quantity AS size, CASE WHEN l_returnflag = 'R' THEN 'Arial-Bold' ELSE 'Arial' END AS fontname FROM lineitem"
_GUTTERS = f"""w AS (SELECT *, x0 + 10 AS centre FROM ({_WORDS})),
bins AS (SELECT doc_id, page, floor(centre / 600 * 50)::BIGINT AS bin, count(*) AS c FROM w GROUP BY 1, 2, 3),
pages_ AS (SELECT doc_id, page FROM w GROUP BY 1, 2 HAVING count(*) >= 30),
dense AS (SELECT p.doc_id, p.page, r.bin, coalesce(c, 0) AS c FROM pages_ p CROSS JOIN (SELECT unnest(range(50)) AS bin) r LEFT JOIN bins b ON b.doc_id = p.doc_id AND b.page = p.page AND b.bin = r.bin),
smooth AS (SELECT *, (lag(c, 1, 0) OVER o + c + lead(c, 1, 0) OVER o) / 3.0::DOUBLE AS s FROM dense WINDOW o AS (PARTITION BY doc_id, page ORDER BY bin)),
peaks AS (SELECT *, median(s) OVER (PARTITION BY doc_id, page) AS m, lag(s) OVER o AS s0, lead(s) OVER o AS s1 FROM smooth WINDOW o AS (PARTITION BY doc_id, page ORDER BY bin)),
ends AS (SELECT doc_id, page, min(bin) AS p1, max(bin) AS p2 FROM peaks WHERE m > 0 AND bin BETWEEN 1 AND 48 AND s >= 2 * m AND s >= s0 AND s >= s1 GROUP BY 1, 2 HAVING max(bin) > min(bin) AND (max(bin) - min(bin)) / 50.0::DOUBLE >= 0.2),
gutters AS (SELECT doc_id, page, arg_min(bin, (s, bin)) / 50.0::DOUBLE * 600 AS gutter FROM peaks JOIN ends USING (doc_id, page) WHERE bin BETWEEN p1 AND p2 GROUP BY 1, 2)"""


def _page_words(spark, d) -> DataFrame:
    at = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("seq"), F.concat(F.lit("w"), "l_partkey").alias("text"), F.expr(_X0).cast("double").alias("x0"), ((F.col("l_orderkey") % 40) * F.lit(2.5)).alias("top"), F.lit(600.0).alias("page_width"), F.col("l_quantity").alias("size"), F.when(F.col("l_returnflag") == "R", "Arial-Bold").otherwise("Arial").alias("fontname"))
    return at.withColumn("x1", F.col("x0") + 20)


@query(f"WITH {_GUTTERS} SELECT doc_id, page, gutter FROM gutters")
def page_gutters(spark, d):
    """The x between two columns of words, for pages that have two."""
    return layout.gutters(_page_words(spark, d))


@query(f"""WITH RECURSIVE {_GUTTERS},
sides AS (SELECT w.*, fontname LIKE '%Bold' AS bold, coalesce(centre >= gutter, false)::INT AS col FROM w LEFT JOIN gutters USING (doc_id, page)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, col ORDER BY top, x0, seq, text, size, bold) AS i FROM sides),
walk AS (SELECT doc_id, page, col, i, 0 AS line, top AS begin_ FROM ordered WHERE i = 1
  UNION ALL SELECT o.doc_id, o.page, o.col, o.i, line + (abs(top - begin_) > 3)::INT, CASE WHEN abs(top - begin_) > 3 THEN top ELSE begin_ END FROM walk JOIN ordered o ON o.doc_id = walk.doc_id AND o.page = walk.page AND o.col = walk.col AND o.i = walk.i + 1),
found AS (SELECT doc_id, page, col, line, string_agg(text, ' ' ORDER BY x0, seq, text) AS text, max(size) AS max_font_size, bool_or(bold) AS is_bold, min(top) AS top FROM ordered JOIN walk USING (doc_id, page, col, i) GROUP BY 1, 2, 3, 4)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, col, line)::INT AS line_no, text, max_font_size, is_bold, top, col, page FROM found""")
def page_lines(spark, d):
    """Lines of pages in reading order, the left column first."""
    return layout.lines(_page_words(spark, d))


# --- keyed tables ------------------------------------------------------------------------------


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN length(s_name)::DOUBLE ELSE s_acctbal END AS first FROM supplier")
def embedding_backfill(spark, d):
    """Only rows without an embedding get one; it is a stand-in of one number here."""
    at = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", F.when(F.col("s_suppkey") % 3 != 0, F.array("s_acctbal")).alias("embedding"))
    return store.backfill_embeddings(at, F.array(F.length("s_name").cast("double"))).select("id", F.col("embedding")[0].alias("first"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'new ' || p_name ELSE p_name END AS title, p_type AS description, CASE WHEN p_partkey % 6 = 0 THEN 'senior' ELSE p_brand END AS experience,
  CASE WHEN p_partkey % 4 = 0 THEN length('new ' || p_name || p_type) ELSE p_size END::DOUBLE AS first FROM part""")
def vacancy_updates(spark, d):
    """Given fields change; only changed texts are embedded anew."""
    at = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_brand").alias("experience"), F.array(F.col("p_size").cast("double")).alias("embedding"))
    even = F.when(F.col("id") % 4 == 0, F.concat(F.lit("new "), "title")).otherwise(F.col("title"))
    change = at.where("id % 2 = 0").select("id", even.alias("title"), F.lit(None).cast("string").alias("description"), F.when(F.col("id") % 6 == 0, "senior").alias("experience"))
    out = store.update_vacancies(at, change, F.array(F.length(F.concat("title", "description")).cast("double")))
    return out.select("id", "title", "description", "experience", F.col("embedding")[0].alias("first"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'known' WHEN doc_id % 3 != 0 THEN sha256(text) END AS content_hash FROM documents")
def hash_backfill(spark, d):
    """Missing hashes from files; a row whose file is gone keeps none."""
    docs = _t(spark, d, "documents")
    path = F.concat(F.lit("cv/"), "doc_id")
    at = docs.select("doc_id", path.alias("source_file"), F.when(F.col("doc_id") % 2 == 0, "known").alias("content_hash"))
    held = docs.where("doc_id % 3 != 0").select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    return store.backfill_hashes(at, held).select("doc_id", "content_hash")


_FILE = "CASE doc_id % 3 WHEN 0 THEN 'resume_csv_' WHEN 1 THEN 'resumeXcsvY' ELSE 'cv/' END || doc_id"


@query(f"""WITH f AS (SELECT {_FILE} LIKE 'resume_csv_%' AS eval FROM documents)
SELECT 'eval' AS scope, count(*) FILTER (eval) AS n FROM f UNION ALL SELECT 'production', count(*) FILTER (NOT eval) FROM f UNION ALL SELECT 'all', count(*) FROM f""")
def eval_scopes(spark, d):
    """Candidates that a ranking sees in each scope."""
    at = _t(spark, d, "documents").select(F.expr(_FILE).alias("source_file"))
    counts = [ranking.in_scope(at, s).agg(F.lit(s).alias("scope"), F.count(F.lit(1)).alias("n")) for s in ("eval", "production", "all")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
