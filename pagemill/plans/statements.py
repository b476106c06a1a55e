"""Queries on what kind of page a page is, and on its score for a request. Pages are the documents of the
tables with a head, some row labels and a foot put around their text by their number, so that every rule
meets pages that it holds for. A document of pages is a source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import classify, marks, retrieval, scoring, statements
from pagemill.operators.keys import join_groups
from pagemill.operators.keywords import keyword_rows
from pagemill.plans.index import LETTER_ENCODER, letters_sql
from pagemill.plans.registry import fold_sql, hits_sql, list_sql, loosen_sql, query, quote, read, spread
from pagemill.sources.shared import kept
from pagemill.sources.vectors import encoded

HEADS = (
    "Bilan Actif en milliers de dirhams", "Bilan - Passif, exercice clos", "Compte de produits et charges en MAD", "Compte de résultat consolidé, situation financière", "Note annexe: détail des créances, état des variations",
    "Tableau des flux de trésorerie", "Principes comptables: les actifs sont évalués au coût amorti", "Information sectorielle: résultat sectoriel par pôle", "Ventilation des créances par devises", "En hausse de 3%, la direction voit des perspectives",
    "Filiale étrangère: taux de change et franc CFA", "Bilan consolidé IFRS part du groupe intérêts minoritaires", "Bilan social, états de synthèse, actif passif", "Durée résiduelle: jusqu'à 3 mois, plus de 5 ans", "Hors bilan: engagements", "Annexe", "Comptes sociaux: bilan passif",
    "Produit net bancaire: intérêts et produits assimilés, coût du risque, compte de résultat en dirhams", "Composantes de l'actif en millions", "Co-entreprises et entreprises associées", "Bilan", "Texte", "Actif", "Situation financière: actif, passif",
)
FEET = ("Total actif", "Total de l'actif et total passif", "Total du passif", "Total général", "Total des produits", "", "résultat net, total des charges", "solde d'ouverture, augmentation, diminution", "passif", "détail des postes")
COUNTS = (0, 2, 4, 6, 9, 11, 13, 14)
_SIGNATURES = [*scoring.DEFAULT.signatures.values()]
#: The number of a page's parts, in SQL of both engines.
HEAD, SIGNATURE, COUNT, FOOT = (f"CAST(doc_id % {len(HEADS)} + 1 AS INT)", f"CAST(floor(doc_id / 3) % {len(_SIGNATURES) + 1} + 1 AS INT)", f"CAST(floor(doc_id / 5) % {len(COUNTS)} + 1 AS INT)", f"CAST(floor(doc_id / 7) % {len(FEET)} + 1 AS INT)")
REQUESTS = [(1, "asset", "consolidated", "bank"), (2, "asset", "statutory", "other"), (3, "liability", "statutory", "other"), (4, "liability", "consolidated", "insurance"), (5, "income", "consolidated", "bank"), (6, "income", "statutory", "insurance")]
SECTORS = ("bank", "insurance", "other")


def pages(spark, d) -> DataFrame:
    lists = [F.array(*map(F.lit, s)) for s in _SIGNATURES] + [F.array(F.lit("sans objet"))]
    label = lambda n: F.element_at(F.array(*map(F.lit, n[0])), F.expr(n[1]))
    rows = F.array_join(F.slice(F.element_at(F.array(*lists), F.expr(SIGNATURE)), F.lit(1), label((COUNTS, COUNT))), " 12 500; ")
    text = F.concat_ws("\n", label((HEADS, HEAD)), rows, label((FEET, FOOT)), "text")
    docs = spread(read(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", text.alias("text"), F.expr(f"element_at(array{tuple(SECTORS)}, CAST(floor(doc_id / 11) % 3 + 1 AS INT))").alias("sector"))
    return T.with_folded(docs)


_PAGES = (
    f"WITH t AS (SELECT doc_id, source, concat_ws(chr(10), {list_sql(HEADS)}[{HEAD}], array_to_string(list_slice([{', '.join(map(list_sql, _SIGNATURES))}, ['sans objet']][{SIGNATURE}], 1, {list(COUNTS)}[{COUNT}]), ' 12 500; '), {list_sql(FEET)}[{FOOT}], text) AS text, {list_sql(SECTORS)}[CAST(floor(doc_id / 11) % 3 + 1 AS INT)] AS sector FROM documents), "
    f"p AS MATERIALIZED (SELECT doc_id, source, sector, text, {fold_sql('text')} AS f FROM t), d AS MATERIALIZED (SELECT *, {loosen_sql('f')} AS l FROM p)"
)


def rule_sql(rule: marks.Rule) -> str:
    if isinstance(rule, marks.Marks):
        head = "f" if rule.window is None else f"left(f, {rule.window})"
        found = [f"contains({head}, {quote(p)})" for p in rule.phrases]
        return "(" + " OR ".join(found) + ")" if rule.least <= 1 else "(" + " + ".join(f"CAST({x} AS INT)" for x in found) + f" >= {rule.least})"
    if isinstance(rule, marks.Pattern):
        return f"regexp_matches({'f' if rule.window is None else f'left(f, {rule.window})'}, {quote(rule.regex)})"
    if isinstance(rule, marks.Named):
        return rule.name
    if isinstance(rule, marks.Not):
        return f"NOT {rule_sql(rule.part)}"
    return "(" + (" AND " if isinstance(rule, marks.All) else " OR ").join(map(rule_sql, rule.parts)) + ")"


def flags_sql(rules: dict[str, marks.Rule], start: str, end: str) -> str:
    """Tables that add a column for each rule, from table start to table end."""
    out, last = [], start
    levels = marks._levels(rules)
    for i, names in enumerate(levels):
        name = end if i == len(levels) - 1 else f"{end}{i}"
        out.append(f"{name} AS MATERIALIZED (SELECT *, {', '.join(f'{rule_sql(rules[n])} AS {n}' for n in names)} FROM {last})")
        last = name
    return ", ".join(out)


_KINDS = f"{_PAGES}, {flags_sql(statements.RULES, 'd', 'k')}"


def _told(names) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in names) + ")"


@query(f"{_KINDS} SELECT doc_id, {_told(statements.RULES)} AS kinds FROM k")
def page_kinds(spark, d):
    rows = statements.with_kinds(pages(spark, d))
    return rows.select("doc_id", F.concat_ws(",", *(F.when(F.col(n), F.lit(n)) for n in statements.RULES)).alias("kinds"))


_CONTEXT = statements.context_rules()


@query(f"{_KINDS}, {flags_sql(_CONTEXT, 'k', 'x')} SELECT doc_id, {_told(_CONTEXT)} AS vetoes FROM x")
def context_vetoes(spark, d):
    rows = marks.with_rules(statements.with_kinds(pages(spark, d)), _CONTEXT)
    return rows.select("doc_id", F.concat_ws(",", *(F.when(F.col(n), F.lit(n)) for n in _CONTEXT)).alias("vetoes"))


# Kept results by the number of their page; their pages get a line that vetoes may speak of.
_SAID = ("Tableau des flux de trésorerie, total actif", "bilan arreda", "Détail des postes", "Passif financier, total passif", "L actif et ses composantes en millions", "L actif et ses composantes en millions, total general i ii iii", "Comptes sociaux", "Comptes consolidés", "Comptes sociaux et comptes consolidés", "Texte")
_KEPT = {
    "target": "CASE doc_id % 3 WHEN 0 THEN 'asset' WHEN 1 THEN 'liability' ELSE 'income' END",
    "scope": "CASE WHEN doc_id % 2 = 0 THEN 'consolidated' ELSE 'statutory' END",
    "sector": "CASE WHEN floor(doc_id / 2) % 2 = 0 THEN 'bank' ELSE 'other' END",
    "top": "CAST(doc_id % 5 * 100 AS DOUBLE)",
}


@query(
    f"WITH t AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _KEPT.items())}, CASE WHEN doc_id % 17 = 0 THEN 3 ELSE 4 END AS box_size, doc_id % 4 < 3 AS header, CASE WHEN doc_id % 23 = 0 THEN '' ELSE {fold_sql(f"{list_sql(_SAID)}[CAST(floor(doc_id / 3) % {len(_SAID)} + 1 AS INT)]")} END AS f FROM documents), {flags_sql(statements.page_context(), 't', 'x')} "
    "SELECT doc_id, CASE WHEN f = '' THEN '' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN {when} THEN '{name}' END" for name, when in statements.VETOES.items()) + ") END AS vetoes FROM x"
)
def cached_vetoes(spark, d):
    said = F.element_at(F.array(*map(F.lit, _SAID)), F.expr(f"CAST(floor(doc_id / 3) % {len(_SAID)} + 1 AS INT)"))
    rows = read(spark, d, "documents").select("doc_id", *(F.expr(v).alias(k) for k, v in _KEPT.items()), T.fold(F.when(F.col("doc_id") % 23 == 0, "").otherwise(said)).alias("folded"))
    box = F.when(F.col("doc_id") % 17 == 0, F.array(F.lit(0.0), "top", F.lit(1.0))).otherwise(F.array(F.lit(0.0), "top", F.lit(1.0), F.lit(2.0)))
    rows = rows.select("*", box.alias("bbox"), F.when(F.col("doc_id") % 4 < 3, F.array(F.lit("x"), F.lit("localized:Line_Header"))).alias("evidence")).drop("top")
    return statements.cached_vetoes(rows).select("doc_id", F.array_join("vetoes", ",").alias("vetoes"))


_TITLES = {"asset": [r"^(.{0,40} )?bilan (- )?actif", r"\bactif\b.{0,20}\bpassif\b"], "liability": [r"bilan (- )?passif"], "income": [r"compte de (produits|resultat)"]}


@query(f"{_PAGES} SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches({c}, {quote(p)})" for p in ps for c in ("f", "l")) + f" THEN '{t}' END" for t, ps in _TITLES.items()) + "], lambda x: x IS NOT NULL), ',') AS titles FROM d")
def title_flags(spark, d):
    return pages(spark, d).select("doc_id", F.array_join(classify.titles(F.col("folded"), F.col("loosened"), _TITLES), ",").alias("titles"))


_KEYWORDS = [(kind, name, i, w) for kind, table in (("anchor", scoring.DEFAULT.anchors), ("title", scoring.DEFAULT.titles), ("scope", scoring.DEFAULT.scopes)) for name, words in table.items() for i, w in enumerate(words)]


@query(
    f"{_PAGES}, w(kind, name, keyword, loose) AS (VALUES " + ", ".join(f"({quote(k)}, {quote(n)}, {quote(w)}, {quote(T.loose_keyword(w) if len(w.split()) > 1 else '')})" for k, n, _, w in _KEYWORDS) + ") "
    "SELECT doc_id, kind, name, CAST(count(*) AS INT) AS hits FROM d JOIN w ON contains(f, keyword) OR (loose <> '' AND contains(l, loose)) GROUP BY ALL"
)
def keyword_table(spark, d):
    table = spark.createDataFrame(_KEYWORDS, "kind string, name string, ord int, keyword string")
    return keyword_rows(pages(spark, d), table, ["doc_id"])


@query(f"{_PAGES} SELECT doc_id, round(len(list_distinct({hits_sql(scoring.DEFAULT.anchors['asset'])})) / {float(len(set(scoring.DEFAULT.anchors['asset'])))}, 9) AS ratio FROM d")
def signature_ratio(spark, d):
    words = list(scoring.DEFAULT.anchors["asset"])
    rows = pages(spark, d).select("doc_id", T.keyword_hits(F.col("folded"), F.col("loosened"), words).alias("h"))
    return rows.select("doc_id", F.round(retrieval.signature_ratio(F.col("h"), len(set(words))), 9).alias("ratio"))


# Scores.
_SCOPE_WORDS = {"consolidated": ["consolide", "ifrs"], "statutory": ["comptes sociaux", "bilan social", "annexe"]}


def inputs(spark, d) -> DataFrame:
    """Pages with the scopes and titles that earlier steps find."""
    found = classify.titles(F.col("folded"), F.col("loosened"), _TITLES)
    return pages(spark, d).withColumn("scopes", classify.ranked_hits(F.col("folded"), F.col("loosened"), _SCOPE_WORDS)).withColumn("titles", found)


def _coverage_sql(hits: str, n: int, groups, saturation: int) -> str:
    """From a list of distinct hits."""
    found = " + ".join("CAST(" + " OR ".join(f"len(list_filter({hits}, lambda x: contains(x, {quote(w)}))) > 0" for w in g) + " AS INT)" for g in groups)
    base = f"0.75 * (0.25 * least(len({hits}) / {float(saturation)}, 1.0) + 0.75 * (len({hits}) / {float(n)})) + 0.25 * ({found}) / {len(groups)}"
    return f"CAST(least(greatest(CASE WHEN len({hits}) <= 3 THEN ({base}) * 0.35 WHEN len({hits}) <= 6 THEN ({base}) * 0.7 ELSE {base} END, 0), 1) AS DOUBLE)"


def _features_sql() -> str:
    v = scoring.DEFAULT
    hits = {f"h_{t}_{s}": w for (t, s), w in v.signatures.items()} | {f"h_{t}": w for t, w in v.anchors.items()}
    scopes = "list_transform(list_reverse_sort(list_filter([" + ", ".join(f"struct_pack(n := len({hits_sql(w)}), name := '{k}')" for k, w in _SCOPE_WORDS.items()) + "], lambda x: x.n > 0)), lambda x: x.name)"
    titles = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches({c}, {quote(p)})" for p in ps for c in ("f", "l")) + f" THEN '{t}' END" for t, ps in _TITLES.items()) + "], lambda x: x IS NOT NULL)"
    first = f"h0 AS MATERIALIZED (SELECT *, {', '.join(f'list_distinct({hits_sql(w)}) AS {n}' for n, w in hits.items())}, {scopes} AS scopes, {titles} AS titles FROM e)"
    cols = []
    for t in scoring.TARGETS:
        groups = v.required[t]
        cols.append(f"{_coverage_sql(f'h_{t}', len(set(v.anchors[t])), groups, scoring.SATURATION[t])} AS {t}_anchor")
        for s in scoring.SCOPES:
            n = len(set(v.signatures[t, s]))
            cols += [f"len(h_{t}_{s}) AS {t}_{s}_n", f"{_coverage_sql(f'h_{t}_{s}', n, groups, scoring.SATURATION[t])} AS {t}_{s}_sig", f"len(h_{t}_{s}) / CAST({n} AS DOUBLE) AS {t}_{s}_cov"]
    beside = ", ".join(f"{f}({c}) OVER w AS {p}_{c}" for c in ("asset_main", "liability_main", "asset_complete", "liability_complete", "any_main") for f, p in (("lag", "previous"), ("lead", "next")))
    requests = ", ".join(f"({q}, '{t}', '{s}', '{x}')" for q, t, s, x in REQUESTS)
    terms = ", ".join(f"{sql} AS {name}" for name, sql in scoring.TERMS.items())
    return (
        f"{_KINDS}, {flags_sql(scoring.extra_rules(v), 'k', 'e')}, {first}, h1 AS MATERIALIZED (SELECT * EXCLUDE (text, f, l), {', '.join(cols)}, {beside} FROM h0 WINDOW w AS (PARTITION BY source ORDER BY doc_id)), "
        f"rq(query_id, target, scope, wanted_sector) AS (VALUES {requests}), r0 AS (SELECT *, {terms} FROM h1, rq)"
    )


def chains_sql(start: str, names: tuple[str, ...] = ()) -> tuple[str, str]:
    """Tables for the chains of scores from table start; and the last table's name."""
    out, last, i = [], start, 0
    for name, begin, steps in scoring.CHAINS:
        if names and name not in names:
            continue
        out.append(f"z{i} AS (SELECT *, CAST({begin} AS DOUBLE) AS {name} FROM {last})")
        last, i = f"z{i}", i + 1
        for step in steps:
            out.append(f"z{i} AS (SELECT * REPLACE ({scoring.step_sql(name, step)} AS {name}) FROM {last})")
            last, i = f"z{i}", i + 1
        out.append(f"zm{i} AS MATERIALIZED (SELECT * FROM {last})")
        last = f"zm{i}"
    return ", ".join(out), last


def requested(spark, d) -> DataFrame:
    return scoring.requested(scoring.page_features(inputs(spark, d), "source", "doc_id"), REQUESTS)


_TERM_CHAINS, _TERM_LAST = chains_sql("r0", ("anchor_score", "scope_score", "title_score", "layout"))
_FOUR = ("anchor_score", "scope_score", "title_score", "layout")


@query(f"{_features_sql()}, {_TERM_CHAINS} SELECT query_id, doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in _FOUR)}, round(sig, 6) AS sig, round(opposite, 6) AS opposite, CAST(n_labels AS INT) AS n_labels FROM {_TERM_LAST}")
def score_terms(spark, d):
    rows = requested(spark, d)
    for name, start, steps in scoring.CHAINS[:4]:
        rows = scoring.chain(rows, name, start, steps)
    return rows.select("query_id", "doc_id", *(F.round(c, 6).alias(c) for c in (*_FOUR, "sig", "opposite")), F.col("n_labels").cast("int").alias("n_labels"))


# Dominance alone, from made-up values that reach every step.
_GRID = "SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 2 AS INT) AS income, CAST(l_quantity % 15 AS INT) AS n_labels, l_discount * 10 AS sig0, l_tax * 12.5 AS coverage, CASE WHEN l_orderkey % 3 = 0 THEN 0.75 WHEN l_orderkey % 3 = 1 THEN 0.5 ELSE 0.2 END AS title_score, CASE WHEN l_orderkey % 4 = 0 THEN 0.1 ELSE 0.75 END AS scope_score, CAST(l_partkey % 100 AS DOUBLE) / 100 AS start FROM lineitem"
_GRID_2 = "SELECT *, CASE WHEN income = 1 THEN 12 ELSE 10 END AS dense, CASE WHEN n_labels = 0 THEN 0.0 ELSE least(sig0, 1.0) END AS sig, CAST(l_linenumber AS DOUBLE) / 7 AS opposite FROM g"


def _steps_sql(start: str, steps) -> tuple[str, str]:
    out, last = [], start
    for i, step in enumerate(steps):
        out.append(f"y{i} AS (SELECT * REPLACE ({scoring.step_sql('score', step)} AS score) FROM {last})")
        last = f"y{i}"
    return ", ".join(out), last


_DOMINANCE, _DOMINANCE_LAST = _steps_sql("x", scoring.DOMINANCE_STEPS)


@query(f"WITH g AS ({_GRID}), h AS ({_GRID_2}), x AS (SELECT *, CAST(start AS DOUBLE) AS score FROM h), {_DOMINANCE} SELECT l_orderkey, l_linenumber, round(score, 6) AS score FROM {_DOMINANCE_LAST}")
def signature_dominance(spark, d):
    lines = read(spark, d, "lineitem")
    grid = lines.selectExpr(*_items(_GRID))
    grid = grid.selectExpr(*_items(_GRID_2))
    return scoring.chain(grid, "score", "start", scoring.DOMINANCE_STEPS).select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


def _items(sql: str) -> list[str]:
    """The select list of SELECT ... FROM table; commas within parentheses don't separate."""
    body = re.match(r"SELECT (.*) FROM \w+$", sql)[1]
    out, depth, begin = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(body[begin:i])
            begin = i + 1
    return [*out, body[begin:]]


def target_query(target: str, scope: str, v: scoring.Vocabulary = scoring.DEFAULT) -> str:
    """The words that a search for a target asks for: its name, its scope's words, titles and row labels."""
    return " ".join([target, *v.scopes[scope], *v.titles[target], *v.signatures[target, scope]])


def _counted(terms: list[str]) -> list[tuple[str, int]]:
    return [(t, terms.count(t)) for t in dict.fromkeys(terms)]


_QUERY_TERMS = [(q, t, n) for q, target, scope, _ in REQUESTS for t, n in _counted(re.findall("[a-z0-9]+", target_query(target, scope)))]


def _labelled(rows: DataFrame, text: str) -> Column:
    """Pages as retrieval reads them: named fields, then the text."""
    fields = {"company": F.col("source"), "sector": F.col("sector"), "scope": F.array_join("scopes", " "), "titles": F.array_join("titles", " ")}
    return T.labelled_text(fields, F.col(text))


def full_scores(spark, d) -> DataFrame:
    """Every page for every request with all terms and its score. Texts are folded once, for features and for
    terms; features are kept, without text, before requests meet them. Pages and requests get their vectors from
    one encoder; a page without one scores 0 there."""
    rows = kept(inputs(spark, d), "pages")
    features = scoring.page_features(rows, "source", "doc_id")
    asked = spark.createDataFrame(_QUERY_TERMS, "query_id long, term string, weight int")
    # Fields are short: folded by themselves they add the same terms as if they were folded with the text.
    fields = [F.concat(F.lit(f"{k}: "), F.coalesce(c, F.lit(""))) for k, c in {"company": F.col("source"), "sector": F.col("sector"), "scope": F.array_join("scopes", " "), "titles": F.array_join("titles", " ")}.items()]
    own = rows.select("doc_id", "source", F.concat_ws(" ", T.fold(F.concat_ws(" ", *fields)), F.lit("page text"), "folded").alias("body"))
    lexical = retrieval.bm25(own, "doc_id", "source", "body", asked, is_folded=True)
    pages = kept(encoded(rows.select("source", "doc_id", _labelled(rows, "text").alias("text")), "text", LETTER_ENCODER), "vectors")
    texts = spark.createDataFrame([(q, target_query(t, s)) for q, t, s, _ in REQUESTS], "query_id long, text string")
    wanted = encoded(texts, "text", LETTER_ENCODER).select("query_id", F.col("vector").alias("query"))  # as many as requests
    cosines = pages.filter("vector IS NOT NULL").join(F.broadcast(wanted)).select("query_id", "source", "doc_id", retrieval.cosine(F.col("vector"), F.col("query")).alias("vector"))
    keys = ["query_id", "source", "doc_id"]
    terms = join_groups(cosines, lexical, keys, "full")
    scored = join_groups(scoring.requested(features, REQUESTS), terms, keys, "left").fillna(0.0, ["bm25"])
    scored = retrieval.minmax(scored, ["query_id", "source"], "bm25", "vector")
    return scoring.scored(scored.fillna(0.0, ["vector"]).withColumn("excluded", F.col("doc_id") % 17 == 0))


def _full_sql() -> str:
    weights = " UNION ALL ".join(f"SELECT {q} AS query_id, {quote(t)} AS term, {n} AS weight" for q, t, n in _QUERY_TERMS)
    body = "concat_ws(' ', 'company: ' || source, 'sector: ' || sector, 'scope: ' || array_to_string(scopes, ' '), 'titles: ' || array_to_string(titles, ' '), 'page text: ' || text)"
    bm25 = (
        f"bt AS MATERIALIZED (SELECT doc_id, source, regexp_extract_all({fold_sql(body)}, '[a-z0-9]+') AS ts FROM h0), bst AS (SELECT source, count(*) AS n, sum(greatest(len(ts), 1)) AS total FROM bt GROUP BY source), bq AS ({weights}), "
        "be AS (SELECT doc_id, source, greatest(len(ts), 1) AS dl, unnest(ts) AS term FROM bt), btf AS (SELECT doc_id, source, term, any_value(dl) AS dl, count(*) AS tf FROM be WHERE term IN (SELECT term FROM bq) GROUP BY ALL), bdf AS (SELECT source, term, count(*) AS df FROM btf GROUP BY ALL), "
        "bs AS (SELECT query_id, doc_id, source, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (total / n) + 1e-9))) AS b FROM btf JOIN bdf USING (source, term) JOIN bst USING (source) JOIN bq USING (term) GROUP BY ALL)"
    )
    wanted = ", ".join(f"({q}, list_transform({letters_sql(quote(target_query(t, s)))}, lambda x: CAST(x AS DOUBLE)))" for q, t, s, _ in REQUESTS)
    cosine = f"cv AS (SELECT source, doc_id, list_transform({letters_sql('b')}, lambda x: CAST(x AS DOUBLE)) AS e FROM (SELECT source, doc_id, {body} AS b FROM h0)), cq(query_id, qe) AS (VALUES {wanted}), cc AS (SELECT query_id, source, doc_id, list_dot_product(e, qe) / ((sqrt(list_dot_product(e, e)) + 1e-9) * (sqrt(list_dot_product(qe, qe)) + 1e-9)) AS c FROM cv, cq WHERE list_sum(e) > 0)"
    scale = lambda c: f"CASE WHEN max({c}) OVER g - min({c}) OVER g < 1e-12 THEN 0.0 ELSE ({c} - min({c}) OVER g) / (max({c}) OVER g - min({c}) OVER g) END"
    joined = f"j AS (SELECT r0.*, coalesce(b, 0.0) AS b, c FROM r0 LEFT JOIN bs USING (query_id, source, doc_id) LEFT JOIN cc USING (query_id, source, doc_id)), j2 AS MATERIALIZED (SELECT * EXCLUDE (b, c), CAST({scale('b')} AS DOUBLE) AS bm25, CAST(coalesce({scale('c')}, 0.0) AS DOUBLE) AS vector, doc_id % 17 = 0 AS excluded FROM j WINDOW g AS (PARTITION BY query_id, source))"
    chains, last = chains_sql("j2")
    return f"{_features_sql()}, {bm25}, {cosine}, {joined}, {chains}, full_score AS MATERIALIZED (SELECT * FROM {last})"


@query(
    f"{_full_sql()} SELECT query_id, source, doc_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 5) DESC, doc_id) AS INT) AS rank, round(bm25, 5) AS bm25, round(vector, 5) AS vector FROM full_score QUALIFY rank <= 8"
)
def full_blend(spark, d):
    rows = full_scores(spark, d).select("query_id", "source", "doc_id", *(F.round(c, 5).alias(c) for c in ("score", "bm25", "vector")))
    return retrieval.top_k(rows, ["query_id", "source"], "score", ["doc_id"], 8)


_OTHER_ONLY = "CASE scope WHEN 'consolidated' THEN statutory_page AND NOT consolidated_page ELSE consolidated_page AND NOT statutory_page END"
_TOLD = ", ".join(f"'{k}:' || " + ("CAST(n_labels AS VARCHAR)" if c == "n_labels" else f"printf('%.3f', round({c}, 3))") for k, c in scoring.TOLD.items())
_WHY = ", ".join(scoring.reasons(scoring.REASON_TEXT))


#: SQL of scoring.retrieved() on full_scores(), for the columns that are wanted.
RETRIEVED_SQL = (
    f"{_full_sql()}, y0 AS (SELECT *, round(score, 9) AS sc, round(0.48 * sig + 0.32 * anchor_score + 0.15 * title_score + 0.05 * scope_score, 9) AS ky, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, doc_id) AS r0 FROM full_score QUALIFY r0 <= 8), "
    "y1 AS (SELECT *, count(*) OVER w AS nn, max(sc) FILTER (WHERE r0 = 1) OVER w - max(sc) FILTER (WHERE r0 = 2) OVER w AS gap FROM y0 WINDOW w AS (PARTITION BY query_id, source)), y2 AS (SELECT *, coalesce(gap < 0.045, false) AND r0 <= 6 AS near FROM y1), "
    "y3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY CASE WHEN r0 <= 6 THEN 0 ELSE 1 END, CASE WHEN near THEN ky END DESC NULLS LAST, CASE WHEN near THEN sig END DESC NULLS LAST, CASE WHEN near THEN anchor_score END DESC NULLS LAST, CASE WHEN near THEN title_score END DESC NULLS LAST, CASE WHEN near THEN doc_id END NULLS FIRST, r0) AS rk FROM y2), "
    f"y4 AS (SELECT *, NOT {_OTHER_ONLY} AS keep FROM y3), y5 AS (SELECT *, bool_or(keep) OVER (PARTITION BY query_id, source) AS any_kept FROM y4) "
).replace("{", "{{").replace("}", "}}") + "SELECT {columns} FROM y5 WHERE keep OR NOT any_kept"
_EVIDENCE = (
    f"concat_ws('|', {_WHY}, {_TOLD}, CASE WHEN sector_score > 0 THEN 'sector:' || sector END, CASE WHEN rk = 1 AND r0 > 1 THEN 'retrieval_tiebreak:scope_signature_and_anchors' END, "
    "CASE WHEN rk = 1 AND nn = 1 THEN 'retrieval_margin:single_candidate' WHEN rk = 1 THEN 'retrieval_margin:' || printf('%.4f', round(gap, 4)) END) AS evidence"
)


@query(RETRIEVED_SQL.format(columns=f"query_id, source, doc_id, CAST(rk AS INT) AS rank, round(score, 5) AS score, {_EVIDENCE}"))
def retrieved_pages(spark, d):
    best = scoring.retrieved(full_scores(spark, d), ["query_id", "source"], "doc_id")
    return best.select("query_id", "source", "doc_id", "rank", F.round("score", 5).alias("score"), F.concat_ws("|", "evidence").alias("evidence"))


@query(
    f"{_features_sql()}, k2 AS (SELECT query_id, source, doc_id, NOT CASE scope WHEN 'consolidated' THEN statutory_page AND NOT consolidated_page ELSE consolidated_page AND NOT statutory_page END AS keep FROM r0) "
    "SELECT query_id, doc_id FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id, source) AS any_kept FROM k2) WHERE keep OR NOT any_kept"
)
def requested_scope_filter(spark, d):
    return scoring.same_scope_or_all(requested(spark, d), ["query_id", "source"]).select("query_id", "doc_id")


_WRONG, _WRONG_LAST = _steps_sql("x", scoring.WRONG_STEPS)
_LAYOUT_CHAIN, _LAYOUT_LAST = chains_sql("r0", ("layout",))


@query(f"{_features_sql()}, {_LAYOUT_CHAIN}, x AS (SELECT *, CAST(1 AS DOUBLE) AS score FROM {_LAYOUT_LAST}), {_WRONG} SELECT query_id, doc_id, score AS penalty, layout FROM {_WRONG_LAST}")
def wrong_table_penalty(spark, d):
    rows = scoring.chain(requested(spark, d), "layout", "0.0", scoring.LAYOUT_STEPS)
    return scoring.chain(rows, "penalty", "1.0", scoring.WRONG_STEPS).select("query_id", "doc_id", "penalty", "layout")


@query(f"{_PAGES} SELECT doc_id, md5('company: ' || source || ' sector: ' || sector || ' page text: ' || text) AS text_md5 FROM d")
def embedding_text(spark, d):
    body = T.labelled_text({"company": F.col("source"), "sector": F.col("sector")}, F.col("text"))
    return pages(spark, d).select("doc_id", F.md5(body).alias("text_md5"))


_MADE = "SELECT l_orderkey, l_partkey * 10 + l_linenumber AS page, l_quantity / 50 AS bm25, l_discount * 10 AS vector, l_tax * 10 AS anchor_score, l_linenumber % 4 / CAST(4 AS DOUBLE) AS scope_score, l_suppkey % 3 / CAST(3 AS DOUBLE) AS title_score, l_partkey % 7 / CAST(7 AS DOUBLE) AS sig, l_suppkey % 5 / CAST(5 AS DOUBLE) AS opposite, l_extendedprice % 100 / 1000 + l_linenumber % 2 / CAST(2 AS DOUBLE) AS score FROM lineitem"


@query(
    f"WITH m AS ({_MADE}) SELECT l_orderkey, page, round(bm25, 6) AS bm25, round(vector, 6) AS vector, round(anchor_score, 6) AS anchor, round(scope_score, 6) AS scope, round(title_score, 6) AS title, round(sig, 6) AS signature, round(0 - opposite, 6) AS negative_penalty, round(score, 6) AS final_score FROM m"
)
def score_breakdown(spark, d):
    rows = read(spark, d, "lineitem").selectExpr(*_items(_MADE))
    return rows.select("l_orderkey", "page", scoring.breakdown(rows).alias("b")).select("l_orderkey", "page", "b.*")


_KEY = "0.48 * sig + 0.32 * anchor_score + 0.15 * title_score + 0.05 * scope_score"


@query(
    f"WITH m AS ({_MADE}), r AS (SELECT *, round(score, 9) AS s, round({_KEY}, 9) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(score, 9) DESC, page, bm25, vector) AS rank FROM m QUALIFY rank <= 8), "
    "h AS (SELECT *, coalesce(max(s) FILTER (WHERE rank = 1) OVER w - max(s) FILTER (WHERE rank = 2) OVER w < 0.045, false) AND rank <= 6 AS near FROM r WINDOW w AS (PARTITION BY l_orderkey)) "
    "SELECT l_orderkey, page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN rank <= 6 THEN 0 ELSE 1 END, CASE WHEN near THEN k END DESC NULLS LAST, CASE WHEN near THEN sig END DESC NULLS LAST, CASE WHEN near THEN anchor_score END DESC NULLS LAST, CASE WHEN near THEN title_score END DESC NULLS LAST, CASE WHEN near THEN page END NULLS FIRST, rank) AS INT) AS rank FROM h"
)
def structural_tiebreak(spark, d):
    rows = read(spark, d, "lineitem").selectExpr(*_items(_MADE)).withColumn("s", F.round("score", 9))
    best = retrieval.top_k(rows, ["l_orderkey"], "s", ["page", "bm25", "vector"], 8)
    c = F.col
    key = F.round(retrieval.structural_key(c("sig"), c("anchor_score"), c("title_score"), c("scope_score")), 9)
    return retrieval.tiebreak(best, ["l_orderkey"], "s", [key, c("sig"), c("anchor_score"), c("title_score")], "page").select("l_orderkey", "page", "rank")
