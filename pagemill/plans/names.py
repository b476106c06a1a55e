"""Queries on names, links and searches. Issuers are made of invented words by their numbers, labels are
other writings of them, so that every way to match occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import linking
from pagemill.plans.registry import list_sql, loose_sql, query, quote, read, spread

WORDS = ("atlas", "banque", "comptoir", "delta", "energie", "forage", "groupe", "horizon", "immobilier", "jasmin", "kasbah", "littoral", "mines", "nord", "oasis", "palmier", "quartz", "rif", "sucre", "tanger", "union", "vallee", "wadi", "xenon", "yacht", "zenith", "argan", "brique", "ciment", "dattes", "eclair", "ferme", "gaz", "huiles", "inter", "jardin", "ka", "logistique", "marbre", "navire", "outils", "phosphate", "quai", "route")


def word(n: str) -> str:
    """SQL of both engines: the word of a number."""
    return f"element_at(array({', '.join(map(quote, WORDS))}), CAST(({n}) % {len(WORDS)} + 1 AS INT))"


def issuer(k: str) -> str:
    return f"concat({word(k)}, ' ', {word(f'{k} * 7 + 3')}, ' ', {word(f'{k} * {k} + 11')}, ' ', {word(f'CAST(floor({k} / {len(WORDS)}) AS BIGINT) * 5 + {k} * 3 + 1')})"


def label(k: str) -> str:
    """Another writing of issuer(k), or an unrelated name, by k % 8 of the caller's number."""
    first, second, third, fourth = word(k), word(f"{k} * 7 + 3"), word(f"{k} * {k} + 11"), word(f"CAST(floor({k} / {len(WORDS)}) AS BIGINT) * 5 + {k} * 3 + 1")
    return (
        f"CASE CAST(floor({k} / 5) AS BIGINT) % 8 WHEN 0 THEN upper({issuer(k)}) WHEN 1 THEN concat({issuer(k)}, ' (X', {k}, ')') "
        f"WHEN 2 THEN concat('Société (', {first}, ' ', {second}, ' ', {third}, ' ', {fourth}, ')') WHEN 3 THEN concat({first}, '-', {second}) "
        f"WHEN 4 THEN concat({third}, ' ', {first}, ' ', {second}, ' plus') WHEN 5 THEN concat({fourth}, ', ', {third}, '/', {second}, ' ', {first}) "
        f"WHEN 6 THEN concat('groupe ', {first}, ' autre nom') ELSE concat('inconnu ', {k}) END"
    )


def duck(sql: str) -> str:
    """The same for DuckDB, whose lists are written otherwise."""
    return sql.replace("element_at(array(", "list_extract(list_value(")


def plain_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower(coalesce({x}, '')), 'éèêàùïîç', 'eeeauiic'), '[()\\[\\]{{}}.,;:/\\\\_-]+', ' ', 'g'), '\\s+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")


def words_sql(x: str, without: tuple[str, ...]) -> str:
    return f"list_filter(string_split({plain_sql(x)}, ' '), lambda w: length(w) > 2 AND NOT list_contains({list_sql(without)}, w))"


def aliases_sql(x: str) -> str:
    w = words_sql(x, linking.NOT_INITIALS)
    return f"list_distinct(list_filter(list_concat([{plain_sql(x)}], list_transform(regexp_extract_all(coalesce({x}, ''), '\\(([^)]+)\\)', 1), lambda y: {plain_sql('y')}), [CASE WHEN len({w}) >= 2 THEN array_to_string(list_transform({w}, lambda v: v[1]), '') END]), lambda z: z IS NOT NULL AND z <> ''))"


def score_sql(p: str, q: str, a: str, b: str, wp: str, wq: str) -> str:
    """From plain names, aliases and telling words of both."""
    share = f"CASE WHEN len({wp}) > 0 THEN len(list_intersect({wp}, {wq})) / CAST(len({wp}) AS DOUBLE) ELSE 0 END"
    return (
        f"CASE WHEN {p} = '' OR {q} = '' THEN 0 WHEN {p} = {q} THEN 100 WHEN list_has_any({a}, {b}) THEN 95 WHEN length({p}) >= 8 AND contains({q}, {p}) THEN 80 WHEN length({q}) >= 8 AND contains({p}, {q}) THEN 70 "
        f"WHEN {share} >= 0.8 THEN 75 WHEN {share} >= 0.6 THEN 60 ELSE 0 END"
    )


def named_sql(name: str, table: str, prefix: str) -> str:
    """key columns and what scores need, of column `name` of a table."""
    return f"SELECT *, {plain_sql(name)} AS {prefix}p, {aliases_sql(name)} AS {prefix}a, list_distinct({words_sql(name, linking.NOT_SHARED)}) AS {prefix}w FROM {table}"


@query(
    f"WITH i AS (SELECT c_custkey, {duck(issuer('c_custkey'))} AS name FROM customer), s AS (SELECT s_suppkey, {duck(label('s_suppkey * 5'))} AS lab FROM supplier), "
    f"x AS ({named_sql('name', 'i', 'x')}), y AS ({named_sql('lab', 's', 'y')}), "
    f"z AS (SELECT c_custkey, s_suppkey, {score_sql('xp', 'yp', 'xa', 'ya', 'xw', 'yw')} AS score FROM x, y) "
    "SELECT c_custkey, s_suppkey, CAST(score AS INT) AS score FROM z WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) = 1"
)
def issuer_match(spark, d):
    issuers = read(spark, d, "customer").select("c_custkey", F.expr(issuer("c_custkey")).alias("name"))
    labels = read(spark, d, "supplier").select("s_suppkey", F.expr(label("s_suppkey * 5")).alias("lab"))
    return linking.best_match(issuers, labels, "c_custkey", "name", "s_suppkey", "lab", 60)


_ALIASED = "concat(n_name, ' (', r_name, '-', CAST(n_nationkey AS STRING), ') Groupe Été')"


@query(f"WITH n AS (SELECT n_nationkey, {_ALIASED.replace('STRING', 'VARCHAR')} AS name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_nationkey, array_to_string(list_sort({aliases_sql('name')}), '|') AS names FROM n")
def alias_names(spark, d):
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", F.array_join(F.sort_array(linking.aliases(F.expr(_ALIASED))), "|").alias("names"))


_LINKS = "WITH k AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)(<a\\s[^>]*?href=\"[^\"]*\"[^>]*>[^<]*)', 1) AS h FROM pages), l AS (SELECT page_id, unnest(h) AS a, generate_subscripts(h, 1) - 1 AS pos FROM k), n AS (SELECT page_id, pos, regexp_extract(a, '(?i)href=\"([^\"]*)\"', 1) AS href, trim(regexp_replace(regexp_extract(a, '(?s)>([^<]*)$', 1), '\\s+', ' ', 'g')) AS label FROM l)"


@query(f"{_LINKS} SELECT page_id, CAST(pos AS INT) AS pos, href, label, regexp_extract(url, '^[^:]+://[^/?#]*') || href AS url FROM n JOIN pages USING (page_id)")
def html_links(spark, d):
    return linking.links(read(spark, d, "pages"), "page_id", "html", "url")


# The same links as browsers write them: bare and single-quoted addresses, nested tags, no end tags.
_ODD = "replace(replace(html, '<li><a href=\"', concat('<LI><!-- <a href=x>no</a> --><A CLASS=c title=\"a > b\" HREF = ', chr(39))), '\">', concat(chr(39), '><b>&amp;</b> <i>'))"


@query(f"{_LINKS} SELECT page_id, CAST(pos AS INT) AS pos, href, '& ' || label AS label, NULL::VARCHAR AS url FROM n")
def html_odd_links(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.expr(_ODD).alias("html"))
    return linking.links(pages, "page_id", "html")


# Files of a request: k is a number; the request asks for issuer(k % 50) of 2024.
_REPORT = "CASE WHEN {k} % 2 = 0 THEN 's1' ELSE 'annuel' END"
_SCOPE = "CASE {k} % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'statutory' ELSE 'any' END"
_KIND = "CASE {k} % 5 WHEN 0 THEN 'rfs_juin' WHEN 1 THEN 'rfa' WHEN 2 THEN 'S1' WHEN 3 THEN 'annuel_31-12' ELSE 'doc' END"
_URL = f"concat('https://', CASE WHEN {{k}} % 4 = 0 THEN 'regulator.example' ELSE 'site.example' END, '/', replace({issuer('({k} + CASE WHEN {k} % 9 = 0 THEN 1 ELSE 0 END) % 50')}, ' ', '-'), '_', {_KIND}, '_', CAST(2023 + {{k}} % 2 AS {{t}}), CASE WHEN {{k}} % 7 = 0 THEN '_consolide' ELSE '' END, CASE WHEN {{k}} % 11 = 0 THEN '.html' ELSE '.PDF' END)"


def file_sql(pattern: str, k: str, spark: bool = True) -> str:
    out = pattern.replace("{k}", k).replace("{t}", "STRING" if spark else "VARCHAR")
    return out if spark else duck(out)


def has_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(w)})" for w in words) + ")"


def _url_score_sql(strict: bool) -> str:
    half, yearly = has_sql("u", linking.HALF_YEAR_IN_URL), has_sql("u", linking.ANNUAL_IN_URL)
    conflict = f"CASE WHEN report = 's1' THEN {yearly} AND NOT {half} ELSE {half} AND NOT {yearly} END"
    total = f"CASE WHEN contains(u, 'regulator.example') THEN 40 ELSE 0 END + CASE WHEN contains(u, '2024') THEN 20 ELSE 0 END + least(m, 40) + CASE WHEN CASE WHEN report = 's1' THEN {half} ELSE {yearly} END THEN 25 ELSE 0 END + CASE WHEN contains(u, 'consolid') THEN CASE scope WHEN 'consolidated' THEN 8 WHEN 'statutory' THEN -8 ELSE 0 END ELSE 0 END"
    bad = "NOT contains(u, '.pdf')"
    return f"CASE WHEN {bad} OR {conflict} THEN -100 ELSE {total} END" if strict else f"CASE WHEN {bad} THEN -100 ELSE {total} - CASE WHEN {conflict} THEN 10 ELSE 0 END END"


@query(
    f"WITH o AS (SELECT o_orderkey, lower({file_sql(_URL, 'o_orderkey', False)}) AS u, {duck(issuer('(o_orderkey % 50)'))} AS name, {file_sql(_REPORT, 'o_orderkey')} AS report, {file_sql(_SCOPE, 'o_orderkey')} AS scope FROM orders), v AS (SELECT *, translate(u, '-_', '  ') AS t FROM o), "
    f"x AS ({named_sql('name', 'v', 'x')}), y AS ({named_sql('t', 'x', 'y')}), s AS (SELECT *, {score_sql('xp', 'yp', 'xa', 'ya', 'xw', 'yw')} AS m FROM y) "
    f"SELECT o_orderkey, CAST({_url_score_sql(True)} AS INT) AS strict_score, CAST({_url_score_sql(False)} AS INT) AS lenient_score FROM s"
)
def link_score(spark, d):
    o = spread(read(spark, d, "orders").select("o_orderkey")).select("o_orderkey", F.expr(file_sql(_URL, "o_orderkey")).alias("url"), F.expr(issuer("(o_orderkey % 50)")).alias("name"), F.expr(file_sql(_REPORT, "o_orderkey")).alias("report"), F.expr(file_sql(_SCOPE, "o_orderkey")).alias("scope"))
    scored = linking.url_scores(o, F.col("url"), F.col("name"), F.lit(2024), F.col("scope"), F.col("report"), "regulator.example")
    return scored.select("o_orderkey", "strict_score", "lenient_score")


_K = "(l_orderkey * 3 + l_linenumber)"
_HREF = f"concat('/Files/', {_KIND}, '_', CASE {{k}} % 6 WHEN 0 THEN '2024' WHEN 1 THEN '24' WHEN 2 THEN '2023' WHEN 3 THEN '240' ELSE '' END, CASE WHEN {{k}} % 7 = 0 THEN '_Consolidé' WHEN {{k}} % 7 = 1 THEN '_consolides' ELSE '' END, CASE WHEN {{k}} % 13 = 0 THEN '.html' ELSE '.pdf' END)"
_TEXT = "concat(CASE {k} % 8 WHEN 0 THEN 'Rapport annuel 2024' WHEN 1 THEN 'Comptes du 1er Semestre 24' WHEN 2 THEN 'Communiqué (24)' WHEN 3 THEN 'Résultats 31/12/2024' ELSE 'Lien' END, ' ', CAST({k} AS {t}))"


@query(
    f"WITH l AS (SELECT l_orderkey, l_linenumber AS pos, {file_sql(_HREF, _K, False)} AS href, {file_sql(_TEXT, _K, False)} AS label, CASE WHEN l_orderkey % 2 = 0 THEN 's1' ELSE 'annuel' END AS report, CASE WHEN l_orderkey % 3 = 0 THEN 'consolidated' ELSE 'statutory' END AS scope FROM lineitem), "
    "n AS (SELECT *, lower(href) AS h, translate(lower(label), 'éè', 'ee') AS t FROM l), "
    f"m AS (SELECT *, {has_sql('h', linking.HALF_YEAR_IN_LINK)} OR {has_sql('t', linking.HALF_YEAR_IN_LINK)} AS half, {has_sql('h', linking.ANNUAL_IN_LINK)} OR {has_sql('t', linking.ANNUAL_IN_LINK)} AS yearly, contains(h, 'consolid') OR contains(t, 'consolid') AS joint, contains(h, '2024') OR contains(t, '2024') OR regexp_matches(h, '(^|[^0-9])24([^0-9]|$)') OR regexp_matches(t, '(^|[^0-9])24([^0-9]|$)') AS dated FROM n), "
    "s AS (SELECT l_orderkey, pos, href, CASE WHEN scope = 'consolidated' THEN CASE WHEN joint THEN 20 ELSE -12 END ELSE CASE WHEN joint THEN -15 ELSE 8 END END "
    "+ CASE WHEN report = 's1' THEN CASE WHEN half THEN 25 ELSE 0 END - CASE WHEN yearly THEN 20 ELSE 0 END ELSE CASE WHEN yearly THEN 20 ELSE 0 END - CASE WHEN half THEN 20 ELSE 0 END END + CASE WHEN contains(t, '2024') OR contains(t, '24') THEN 3 ELSE 0 END AS score FROM m "
    "WHERE ends_with(h, '.pdf') AND dated AND NOT CASE WHEN report = 's1' THEN yearly AND NOT half ELSE half AND NOT yearly END) "
    "SELECT l_orderkey, pos, href, CAST(score AS INT) AS score FROM s WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, pos) = 1"
)
def pdf_link(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.expr(file_sql(_HREF, _K)).alias("href"), F.expr(file_sql(_TEXT, _K)).alias("label"))
    report, scope = F.when(F.col("l_orderkey") % 2 == 0, "s1").otherwise("annuel"), F.when(F.col("l_orderkey") % 3 == 0, "consolidated").otherwise("statutory")
    scored = rows.select("l_orderkey", "pos", "href", linking.pdf_link_score(F.col("href"), F.col("label"), F.lit(2024), scope, report).alias("score"))
    return linking.best_link(scored, ["l_orderkey"])


# Pages whose links lead to reports, by the number of the page and the link's own word.
_REPORTS = "replace(replace(html, '<a href=\"/t', '<a href=\"../files/rfs_juin_24_t'), '</a></li>', CASE WHEN page_id % 3 = 0 THEN ' consolidé.</a></li>' ELSE ' 2024</a></li>' END)"


@query(
    f"WITH h AS (SELECT page_id, url, replace({_REPORTS}, '\">', '.pdf\">') AS html FROM pages), {_LINKS.removeprefix('WITH ').replace('FROM pages', 'FROM h')}, m AS (SELECT *, lower(href) AS f, translate(lower(label), 'éè', 'ee') AS t FROM n), "
    f"q AS (SELECT *, page_id % 2 = 0 AS wants_half, page_id % 5 < 2 AS wants_joint, {has_sql('f', linking.HALF_YEAR_IN_LINK)} OR {has_sql('t', linking.HALF_YEAR_IN_LINK)} AS half, {has_sql('f', linking.ANNUAL_IN_LINK)} OR {has_sql('t', linking.ANNUAL_IN_LINK)} AS yearly, contains(f, 'consolid') OR contains(t, 'consolid') AS joint FROM m WHERE ends_with(f, '.pdf') AND (contains(f, '2024') OR contains(t, '2024') OR regexp_matches(f, '(^|[^0-9])24([^0-9]|$)') OR regexp_matches(t, '(^|[^0-9])24([^0-9]|$)'))), "
    "s AS (SELECT *, CASE WHEN wants_joint THEN CASE WHEN joint THEN 20 ELSE -12 END ELSE CASE WHEN joint THEN -15 ELSE 8 END END + CASE WHEN wants_half THEN CASE WHEN half THEN 25 ELSE 0 END - CASE WHEN yearly THEN 20 ELSE 0 END ELSE CASE WHEN yearly THEN 20 ELSE 0 END - CASE WHEN half THEN 20 ELSE 0 END END + CASE WHEN contains(t, '2024') OR contains(t, '24') THEN 3 ELSE 0 END AS score FROM q WHERE NOT CASE WHEN wants_half THEN yearly AND NOT half ELSE half AND NOT yearly END), "
    "b AS (SELECT * FROM s WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1) "
    "SELECT page_id, CAST(pos AS INT) AS pos, CAST(score AS INT) AS score, regexp_extract(p.url, '^[^:]+://[^/?#]*') || CASE WHEN starts_with(href, '../') THEN CASE WHEN regexp_matches(p.url, '^[^:]+://[^/?#]*/[^/?#]*/[^/?#]*/') THEN regexp_extract(p.url, '^[^:]+://[^/?#]*(/(?:[^/?#]*/)*)[^/?#]*/[^/?#]*', 1) ELSE '/' END || href[4:] ELSE href END AS url FROM b JOIN pages p USING (page_id)"
)
def page_pdf_link(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url", F.expr(f"replace({_REPORTS}, '\">', '.pdf\">')").alias("html"))
    k = F.col("page_id")
    found = linking.find_pdf_link(pages, "page_id", "html", "url", F.lit(2024), F.when(k % 5 < 2, "consolidated").otherwise("statutory"), F.when(k % 2 == 0, "s1").otherwise("annuel"))
    return found.select("page_id", "pos", "score", "url")


@query("SELECT page_id, url AS target FROM pages")
def url_unwrap(spark, d):
    coded = F.translate(F.rtrim(F.base64(F.col("url").cast("binary")), F.lit("=")), "+/", "-_")
    plain, hidden = F.concat(F.lit("https://s.example/?uddg="), F.url_encode("url")), F.concat(F.lit("https://b.example/ck?p=1&u=a1"), coded, F.lit("&n=2"))
    wrapped = F.when(F.col("page_id") % 3 == 0, plain).when(F.col("page_id") % 3 == 1, hidden).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", linking.unwrapped(wrapped).alias("target"))


_SECTORS = [("insurance", ["oasis", "assurance"]), ("bank", ["banque", "delta"])]
_WRITTEN = f"CASE c_custkey % 4 WHEN 0 THEN concat('  ', upper({issuer('c_custkey % 40')}), ' ') WHEN 1 THEN replace({issuer('c_custkey % 40')}, ' ', ' - ') WHEN 2 THEN replace({issuer('c_custkey % 40')}, ' ', '''') ELSE concat({issuer('c_custkey')}, ' autre') END"
_KNOWN = issuer("k * 2")


@query(
    f"WITH t AS (SELECT k, {duck(_KNOWN)} AS name, CASE k % 3 WHEN 0 THEN 'bank' WHEN 1 THEN 'insurance' ELSE 'other' END AS sector FROM (SELECT unnest(range(20)) AS k)), c AS (SELECT c_custkey, {duck(_WRITTEN)} AS name FROM customer), "
    "m AS (SELECT c_custkey, c.name, "
    + ", ".join(f"(SELECT min(sector) FROM t WHERE {key('t.name')} = {key('c.name')}) AS s{i}" for i, key in enumerate((lambda x: f"lower(trim({x}))", plain_sql, loose_sql)))
    + f" FROM c) SELECT c_custkey, coalesce(s0, s1, s2, CASE WHEN {has_sql(plain_sql('name'), _SECTORS[0][1])} THEN 'insurance' WHEN {has_sql(plain_sql('name'), _SECTORS[1][1])} THEN 'bank' ELSE 'other' END) AS sector FROM m"
)
def sector_lookup(spark, d):
    known = spark.range(20).withColumnRenamed("id", "k").select(F.expr(_KNOWN).alias("name"), F.expr("CASE k % 3 WHEN 0 THEN 'bank' WHEN 1 THEN 'insurance' ELSE 'other' END").alias("sector"))
    issuers = read(spark, d, "customer").select("c_custkey", F.expr(_WRITTEN).alias("name"))
    return linking.sector_of(issuers, known, "name", _SECTORS).select("c_custkey", "sector")


_ROW = "concat('<tr><td>1</td><td>x</td><td><time datetime=\"', CAST(2015 + o_orderkey % 10 AS STRING), '-06-30\">', CASE WHEN o_orderkey % 3 = 0 THEN CAST(2015 + o_orderkey % 10 AS STRING) ELSE 'juin' END, '</time></td>', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('<td><a href=\"/autre/1\">Autre</a> <a class=\"f\" href=\" /etats-financiers/', CAST(o_orderkey AS STRING), '\"> Annuel ', o_orderpriority, '</a></td>') END, '</tr>')"


@query("SELECT o_orderkey, CAST(0 AS INT) AS row, CASE WHEN o_orderkey % 7 > 0 THEN '/etats-financiers/' || o_orderkey END AS href, CASE WHEN o_orderkey % 7 > 0 THEN CAST(2015 + o_orderkey % 10 AS INT) END AS year, CASE WHEN o_orderkey % 7 > 0 THEN 'Annuel ' || o_orderpriority ELSE '' END AS label FROM orders")
def table_row_link(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.expr(_ROW).alias("html"))
    return linking.table_row_links(rows, "o_orderkey", "html", "/etats-financiers/")


@query("SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS value, s_name AS label FROM supplier WHERE s_suppkey % 5 > 0")
def html_options(spark, d):
    inner = F.concat(F.lit('<select><OPTION value="All">Tous</option><option class="x" value="'), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_suppkey").cast("string")).otherwise(""), F.lit('"> '), "s_name", F.lit("</option></select>"))
    rows = read(spark, d, "supplier").select("s_suppkey", inner.alias("html"))
    return linking.options(rows, "s_suppkey", "html").select("s_suppkey", "value", "label")


_NAME = "concat(upper(substr(c_mktsegment, 1, 3)), '  ', CAST(c_custkey % 60 AS STRING))"


@query(
    f"WITH l AS (SELECT c_custkey, trim({_NAME.replace('STRING', 'VARCHAR')}) AS label, CAST(floor(c_custkey / 50) AS BIGINT) AS page FROM customer WHERE c_custkey % 4 > 0 AND c_custkey % 2 = 0 AND c_custkey % 5 > 0), "
    "f AS (SELECT lower(regexp_replace(label, '\\s+', ' ', 'g')) AS code, label, page FROM l QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(label, '\\s+', ' ', 'g')) ORDER BY page, c_custkey) = 1), "
    "e AS (SELECT min(page) AS e FROM (SELECT DISTINCT CAST(floor(c_custkey / 50) AS BIGINT) AS page FROM customer) WHERE page > 0 AND page NOT IN (SELECT page FROM f)) SELECT code, label FROM f, e WHERE e IS NULL OR page < e"
)
def listed_issuers(spark, d):
    k = F.col("c_custkey")
    href = F.concat(F.when(k % 5 > 0, "/liste/").otherwise("/autre/"), F.when(k % 4 > 0, (k * 3).cast("string")).otherwise("menu"), F.when(k % 2 > 0, "/?p=1").otherwise("/"))
    rows = read(spark, d, "customer").select(F.floor(k / 50).alias("page"), k.alias("pos"), href.alias("href"), F.expr(_NAME).alias("label"))
    return linking.listed_issuers(rows, "/liste/")


@query(
    "WITH b AS (SELECT 'C' || c_custkey % 300 AS code, c_name AS label, 0 AS o FROM customer WHERE c_custkey < 200 UNION ALL SELECT 'c' || s_suppkey * 2, s_name, 1 FROM supplier) "
    "SELECT code, label FROM b QUALIFY row_number() OVER (PARTITION BY lower(code) ORDER BY o DESC, code DESC, label DESC) = 1"
)
def merged_issuers(spark, d):
    stored = read(spark, d, "customer").filter("c_custkey < 200").select(F.concat(F.lit("C"), (F.col("c_custkey") % 300).cast("string")).alias("code"), F.col("c_name").alias("label"))
    fresh = read(spark, d, "supplier").select(F.concat(F.lit("c"), (F.col("s_suppkey") * 2).cast("string")).alias("code"), F.col("s_name").alias("label"))
    return linking.merged_issuers(stored, fresh)


@query(
    "WITH f AS (SELECT user_id, event_id % 2 AS source_rank, event_id AS pos, 'u' || CAST(value AS BIGINT) % 20 AS url FROM events WHERE user_id % 3 > 0 OR event_id % 2 = 1), g AS (SELECT *, min(source_rank) OVER (PARTITION BY user_id) AS best FROM f), "
    "u AS (SELECT user_id, url, min(pos) AS pos FROM g WHERE source_rank = best GROUP BY ALL) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos, url) AS INT) AS rank, url FROM u QUALIFY rank <= 5"
)
def first_urls(spark, d):
    e = read(spark, d, "events").filter("user_id % 3 > 0 OR event_id % 2 = 1")
    # both engines round a cast to a whole number differently, so round first
    found = e.select("user_id", (F.col("event_id") % 2).alias("source_rank"), F.col("event_id").alias("pos"), F.concat(F.lit("u"), (F.bround("value", 0).cast("long") % 20).cast("string")).alias("url"))
    return linking.first_urls(found, ["user_id"], 5)


@query(
    f"WITH c AS (SELECT c_custkey, {duck(issuer('c_custkey'))} AS i, CASE WHEN c_custkey % 2 = 0 THEN 'rapport semestriel' ELSE 'rapport annuel' END AS k, CASE WHEN c_custkey % 3 = 0 THEN 'comptes consolides' ELSE 'comptes sociaux' END AS a FROM customer) "
    "SELECT c_custkey, pos, q FROM (SELECT c_custkey, unnest(['site:reg.example \"' || i || '\" 2024 ' || k || ' filetype:pdf', 'site:reg.example \"' || i || '\" 2024 filetype:pdf', '\"' || i || '\" ' || k || ' 2024 ' || a || ' filetype:pdf', '\"' || i || '\" ' || k || ' 2024 filetype:pdf', i || ' ' || a || ' 2024 filetype:pdf', i || ' ' || k || ' 2024', i || ' etats financiers 2024']) AS q, CAST(unnest(range(7)) AS INT) AS pos FROM c)"
)
def search_queries(spark, d):
    c = read(spark, d, "customer")
    asked = linking.queries_for(F.expr(issuer("c_custkey")), F.lit(2024), F.when(F.col("c_custkey") % 2 == 0, "s1").otherwise("annuel"), F.when(F.col("c_custkey") % 3 == 0, "consolidated").otherwise("statutory"), "reg.example")
    return c.select("c_custkey", F.posexplode(asked).alias("pos", "q"))


_STEM = "concat('Émetteur_', CASE p_partkey % 9 WHEN 0 THEN 'RFA' WHEN 1 THEN 'rfs' WHEN 2 THEN 'x_s1' WHEN 3 THEN 'semestre' WHEN 4 THEN 'annuel_semestre' WHEN 5 THEN 'rfa_rfs' WHEN 6 THEN 'juin' WHEN 7 THEN 'gs1x' ELSE 'doc' END, '_2024')"


@query(
    f"WITH p AS (SELECT p_partkey, translate(lower({_STEM}), 'éè', 'ee') AS s FROM part) SELECT p_partkey, "
    f"CASE WHEN contains(s, 'rfa') AND NOT {has_sql('s', ('rfs', 'semestre', 's1', '1er'))} THEN false ELSE {has_sql('s', ('rfs', 's1', 'semestre', '1er', 'juin'))} END AS half, "
    "NOT (contains(s, '_s1') OR regexp_matches(s, '(^|[^a-z])s1([^a-z]|$)')) AND NOT (contains(s, 'rfs') AND NOT contains(s, 'rfa')) AND NOT (contains(s, 'semestre') AND NOT contains(s, 'annuel') AND NOT contains(s, 'rfa')) AS yearly FROM p"
)
def stem_fits(spark, d):
    return read(spark, d, "part").select("p_partkey", linking.stem_fits(F.expr(_STEM), F.lit("s1")).alias("half"), linking.stem_fits(F.expr(_STEM), F.lit("annuel")).alias("yearly"))


_PAGE = f"concat(CASE WHEN l_linenumber = 1 THEN {issuer('l_orderkey % 30')} ELSE '' END, CASE l_orderkey % 5 WHEN 0 THEN ' rapport annuel' WHEN 1 THEN ' premier semestre' WHEN 2 THEN ' 31/12/2024' ELSE '' END, CASE WHEN l_linenumber = 5 THEN ' hors des premieres pages 2024' WHEN l_linenumber = 2 AND l_orderkey % 3 = 0 THEN ' exercice 2024' ELSE ' texte' END)"


@query(
    f"WITH p AS (SELECT l_orderkey, l_linenumber, {duck(_PAGE)} AS t FROM lineitem WHERE l_linenumber <= 4), h AS (SELECT l_orderkey, {plain_sql("string_agg(t, ' ' ORDER BY l_linenumber)")} AS t, {duck(issuer('l_orderkey % 30'))} AS name FROM p GROUP BY l_orderkey), "
    f"x AS ({named_sql('name', 'h', 'x')}), y AS ({named_sql('t', 'x', 'y')}), s AS (SELECT *, {score_sql('xp', 'yp', 'xa', 'ya', 'xw', 'yw')} AS m, {has_sql('t', linking.HALF_YEAR_IN_REPORT)} AS half, {has_sql('t', linking.ANNUAL_IN_REPORT)} AS yearly FROM y) "
    "SELECT l_orderkey, contains(t, '2024') AND m >= 40 AND NOT CASE WHEN l_orderkey % 2 = 0 THEN yearly AND NOT half ELSE half AND NOT yearly END AS fits FROM s"
)
def requested_report(spark, d):
    pages = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_PAGE).alias("t"))
    heads = linking.first_pages(pages, "l_orderkey", "l_linenumber", "t")
    report = F.when(F.col("l_orderkey") % 2 == 0, "s1").otherwise("annuel")
    return linking.requested_reports(heads, F.col("head"), F.lit(""), F.expr(issuer("l_orderkey % 30")), F.lit(2024), report).select("l_orderkey", "fits")


@query(
    f"WITH o AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 6 = 0 THEN 'ftp://x' ELSE 'https://o.example/' || s_suppkey END AS url, {duck(issuer('s_suppkey % 30'))} AS issuer, [upper({duck(issuer('(s_suppkey + 7) % 30'))})] AS aliases, 2020 + s_suppkey % 3 AS year, CASE WHEN s_suppkey % 2 = 0 THEN 's1' ELSE 'annuel' END AS report, CASE s_suppkey % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN '' END AS scope FROM supplier), "
    f"r AS (SELECT c_custkey, {duck(issuer('c_custkey % 30'))} AS issuer, 2020 + c_custkey % 3 AS year, CASE WHEN c_custkey % 2 = 0 THEN 's1' ELSE 'annuel' END AS report, CASE WHEN c_custkey % 5 = 0 THEN 'consolidated' ELSE 'statutory' END AS scope FROM customer) "
    f"SELECT c_custkey, url FROM r JOIN o ON r.year = o.year AND r.report = o.report AND o.url LIKE 'http%' AND (coalesce(o.scope, '') = '' OR o.scope = r.scope) AND list_has_any({aliases_sql('r.issuer')}, list_concat([{plain_sql('o.issuer')}], list_transform(o.aliases, lambda z: {plain_sql('z')}))) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY pos) = 1"
)
def override_url(spark, d):
    s = read(spark, d, "supplier")
    half = lambda c: F.when(F.col(c) % 2 == 0, "s1").otherwise("annuel")
    url = F.when(F.col("s_suppkey") % 6 == 0, "ftp://x").otherwise(F.concat(F.lit("https://o.example/"), F.col("s_suppkey").cast("string")))
    scope = F.when(F.col("s_suppkey") % 3 == 0, "consolidated").when(F.col("s_suppkey") % 3 == 1, "")
    rows = s.select(F.col("s_suppkey").alias("pos"), url.alias("url"), F.expr(issuer("s_suppkey % 30")).alias("issuer"), F.array(F.upper(F.expr(issuer("(s_suppkey + 7) % 30")))).alias("aliases"), (F.col("s_suppkey") % 3 + 2020).alias("year"), half("s_suppkey").alias("report"), scope.alias("scope"))
    asked = read(spark, d, "customer").select("c_custkey", F.expr(issuer("c_custkey % 30")).alias("issuer"), (F.col("c_custkey") % 3 + 2020).alias("year"), half("c_custkey").alias("report"), F.when(F.col("c_custkey") % 5 == 0, "consolidated").otherwise("statutory").alias("scope"))
    return linking.overrides(asked, rows, "c_custkey")


@query(
    "WITH c AS (SELECT l_orderkey, l_linenumber % 4 AS k, ['cache', 'override', 'web', 'folder'][CAST(l_linenumber % 4 + 1 AS INT)] AS strategy, CAST(l_quantity AS INT) AS score, [0, 0, 40, 10][CAST(l_linenumber % 4 + 1 AS INT)] AS accept, 'u' || l_partkey AS url FROM lineitem) "
    "SELECT l_orderkey, strategy, url FROM c WHERE score >= accept QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY k, score DESC, url, strategy) = 1"
)
def download_cascade(spark, d):
    k = (F.col("l_linenumber") % 4).cast("int")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), k)
    found = read(spark, d, "lineitem").select("l_orderkey", k.alias("strategy_rank"), pick("cache", "override", "web", "folder").alias("strategy"), F.col("l_quantity").cast("int").alias("score"), pick(0, 0, 40, 10).alias("accept"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"))
    return linking.first_success(found, "l_orderkey")


@query("SELECT c_custkey, lower(c_name) AS name FROM customer")
def strip_prefix(spark, d):
    return read(spark, d, "customer").select("c_custkey", T.without_prefix(F.concat(F.lit("  CUSTOMER : - "), "c_name"), "customer").alias("name"))
