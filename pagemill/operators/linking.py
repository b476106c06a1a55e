"""Matching of issuers by names and aliases, of links in web pages, and of files to requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import plain_name
from pagemill.operators.keys import join_groups
from pagemill.sources.html import elements
from pagemill.sources.shared import kept

# Least length of a name that counts where it stands within another; words that don't
# count in initials, and in shares of words; markers of half-year and annual reports in links and files.
INSIDE = 8
NOT_INITIALS = ("societe", "banque", "bank", "groupe")
NOT_SHARED = ("de", "du", "des", "la", "le", "les", "et", "sa", "spa", "societe", "bank", "banque")
HALF_YEAR_IN_URL = ("rfs", "s1", "semestre", "juin", "30-06", "30/06")
ANNUAL_IN_URL = ("rfa", "annuel", "31-12", "31/12")
HALF_YEAR_IN_LINK = ("1er semestre", "premier semestre", "semestr", "rfs", "s1", "30/06")
ANNUAL_IN_LINK = ("annuel", "annuels", "rfa", "31/12")
HALF_YEAR_IN_REPORT = ("1er semestre", "premier semestre", "semestre", "juin", "30/06", "30 06")
ANNUAL_IN_REPORT = ("annuel", "rapports annuels", "rfa", "31/12", "31 12")


def any_of(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _words(plain: Column, without, first_letters: bool = False) -> Column:
    """Words of over two characters of a plain name but `without`; or their first letters."""
    return F.regexp_extract_all(plain, F.lit(rf"(?<![^ ])(?!(?:{'|'.join(without)})(?![^ ]))(([^ ])[^ ]{{2,}})"), F.lit(2 if first_letters else 1))


def aliases(name: Column, plain: Column | None = None) -> Column:
    """The plain name, its parts in parentheses, and the initials of its words of over two characters
    but NOT_INITIALS, if there are two or more."""
    plain = plain_name(name) if plain is None else plain
    inner = F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), 1), plain_name)
    letters = _words(plain, NOT_INITIALS, True)
    initials = F.when(F.size(letters) >= 2, F.array_join(letters, ""))
    every = F.array_remove(F.array_compact(F.array(plain, initials)), "")
    # Few names have parentheses; the others take no step for them.
    return F.array_distinct(F.when(F.contains(name, F.lit("(")), F.array_remove(F.concat(every, inner), "")).otherwise(every))


def telling_words(plain: Column) -> Column:
    """Distinct words of over two characters but NOT_SHARED."""
    return F.array_distinct(_words(plain, NOT_SHARED))


def named(rows: DataFrame, name: Column, prefix: str) -> DataFrame:
    """Adds what scores need of a name: <prefix>_plain, <prefix>_aliases, <prefix>_words. They are columns, so
    each is worked out once a row however many tests read it."""
    plain = f"{prefix}_plain"
    rows = rows.withColumn(plain, plain_name(name))
    return rows.withColumns({f"{prefix}_aliases": aliases(name, F.col(plain)), f"{prefix}_words": telling_words(F.col(plain))})


def name_score(x: str, y: str) -> Column:
    """Of a name and a label, from their named() columns: 100 equal, 95 a shared alias, 80 the name within the
    label, 70 the label within the name, 75 or 60 where the label has 8 or 6 tenths of the name's telling
    words, else 0."""
    p, q, own = F.col(f"{x}_plain"), F.col(f"{y}_plain"), F.col(f"{x}_words")
    share = F.size(F.array_intersect(own, F.col(f"{y}_words"))) / F.greatest(F.size(own), F.lit(1))
    inside = lambda p, q: (F.length(p) >= INSIDE) & F.contains(q, p)
    overlap = F.arrays_overlap(F.col(f"{x}_aliases"), F.col(f"{y}_aliases"))
    return F.when((p == "") | (q == ""), 0).when(p == q, 100).when(overlap, 95).when(inside(p, q), 80).when(inside(q, p), 70).when(share >= 0.8, 75).when(share >= 0.6, 60).otherwise(0)


def with_match(rows: DataFrame, name: Column, label: Column, score: str) -> DataFrame:
    """Adds name_score() of two columns."""
    both = named(named(rows, name, "_x"), label, "_y").withColumn(score, name_score("_x", "_y"))
    return both.drop(*(f"{p}_{c}" for p in ("_x", "_y") for c in ("plain", "aliases", "words")))


def _grams(plain: Column) -> Column:
    """Distinct runs of INSIDE characters."""
    return F.when(F.length(plain) >= INSIDE, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - INSIDE + 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(INSIDE))))).otherwise(F.array().cast("array<string>"))


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    """key, kind, k: what a name can be met by: its words, runs of INSIDE characters, aliases, itself."""
    of = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("k")))
    every = F.concat(of("word", F.col("_words")), of("gram", F.col("_grams")), of("alias", F.col("_aliases")), of("name", F.array("_plain")))
    return rows.select(key, F.inline(every))


def best_match(left: DataFrame, right: DataFrame, left_key: str, left_name: str, right_key: str, right_name: str, least: int = 60) -> DataFrame:
    """The best right row of each left row, the least key on ties. Names are matched once however many rows have
    them: a right name stands for its least key, and what a left name finds goes to all its rows."""
    own = left.select(left_key, F.col(left_name).alias("_name")).filter("_name IS NOT NULL")
    asked = kept(own.select("_name").distinct().withColumn("_id", F.monotonically_increasing_id()), "asked")
    labels = right.groupBy(F.col(right_name).alias("_name")).agg(F.min(right_key).alias(right_key))
    found = _best_match(asked, labels, "_id", "_name", right_key, "_name", least)
    rows = own.join(asked.join(found, "_id").drop("_id"), "_name")
    best = F.max_by(F.struct("score", right_key), F.struct("score", -F.col(right_key))).alias("b")
    return rows.groupBy(left_key).agg(best).select(left_key, f"b.{right_key}", "b.score")


def _best_match(left: DataFrame, right: DataFrame, left_key: str, left_name: str, right_key: str, right_name: str, least: int) -> DataFrame:
    """best_match() of distinct names. Both sides are named once and kept. Pairs meet by every way to score, each by
    its rarest key: equal names and shared aliases (where the least right key is enough), so many words that six
    tenths can't be shared without one of them, and one run of INSIDE characters."""

    def side(rows: DataFrame, key: str, name: str) -> DataFrame:
        own = named(rows.select(key, F.col(name).alias("_name")), F.col("_name"), "").filter("_plain <> ''")
        return kept(own.withColumn("_grams", _grams(F.col("_plain"))).drop("_name"), "names")

    a, b = side(left, left_key, left_name), side(right, right_key, right_name)
    keys_a, keys_b = _keyed(a, left_key), _keyed(b, right_key)
    # Keys that both sides have, and how often.
    both = keys_a.select("kind", "k", F.lit(1).alias("a"), F.lit(None).cast("long").alias("r")).unionAll(keys_b.select("kind", "k", F.lit(0).alias("a"), F.col(right_key).cast("long").alias("r")))
    known = kept(both.groupBy("kind", "k").agg(F.sum("a").alias("na"), F.count("r").alias("nb"), F.min("r").alias("least")).filter("na > 0 AND nb > 0"), "keys")

    def rarest(rows: DataFrame, keys: DataFrame, key: str, often: str, kind: str, column: str, take: Column) -> DataFrame:
        """key, k: of each row so many of its rarest keys; the other side's lack of a key counts as the rarest."""
        found = keys.filter(F.col("kind") == kind).join(known.filter(F.col("kind") == kind).select("k", often), "k")
        own = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(often, "k"))).alias("own"))  # keys of one name
        return own.join(rows.select(key, take.alias("take"), F.size(column).alias("n")), key).select(key, F.explode(F.slice("own", F.lit(1), F.greatest(F.col("take") - (F.col("n") - F.size("own")), F.lit(0)))).alias("o")).select(key, "o.k")

    enough = (F.size("_words") - F.ceil(F.size("_words") * 0.6) + 1).cast("int")
    of = lambda keys, kind: keys.filter(F.col("kind") == kind).drop("kind")
    met = rarest(a, keys_a, left_key, "nb", "word", "_words", enough).join(of(keys_b, "word"), "k")
    met = met.unionByName(rarest(a, keys_a, left_key, "nb", "gram", "_grams", F.lit(1)).join(of(keys_b, "gram"), "k"))
    met = met.unionByName(rarest(b, keys_b, right_key, "na", "gram", "_grams", F.lit(1)).join(of(keys_a, "gram"), "k"))
    pairs = met.select(left_key, right_key).distinct()
    columns = ("plain", "aliases", "words")
    x, y = (rows.select(key, *(F.col(f"_{c}").alias(f"{p}_{c}") for c in columns)) for rows, key, p in ((a, left_key, "_x"), (b, right_key, "_y")))
    scored = pairs.join(x, left_key).join(y, right_key).select(left_key, right_key, name_score("_x", "_y").alias("score"))
    direct = keys_a.filter("kind IN ('name', 'alias')").join(known, ["kind", "k"])
    direct = direct.select(left_key, F.col("least").alias(right_key), F.when(F.col("kind") == "name", 100).otherwise(95).alias("score"))
    best = F.max_by(F.struct("score", right_key), F.struct("score", -F.col(right_key))).alias("b")
    found = scored.unionAll(direct).filter(F.col("score") >= least).groupBy(left_key).agg(best)
    return found.select(left_key, F.col(f"b.{right_key}").alias(right_key), F.col("b.score").alias("score"))


def sector_of(issuers: DataFrame, known: DataFrame, name: str, markers: list[tuple[str, list[str]]], default: str = "other") -> DataFrame:
    """Adds sector: that of the table (name, sector) by the raw, the plain or the punctuation-free name,
    in this order; else the first of markers (sector, words) that the plain name holds; else default."""
    from pagemill.functions.text import loose

    raw = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    rows = issuers
    for i, key in enumerate((raw, plain_name, loose)):
        table = known.select(key(F.col("name")).alias(f"_n{i}"), "sector").groupBy(f"_n{i}").agg(F.min("sector").alias(f"_s{i}"))
        rows = rows.withColumn(f"_n{i}", key(F.col(name))).join(table, f"_n{i}", "left")
    plain = plain_name(F.col(name))
    guess = F.lit(None).cast("string")
    for sector, words in markers:
        guess = F.coalesce(guess, F.when(any_of(plain, words), F.lit(sector)))
    return rows.withColumn("sector", F.coalesce("_s0", "_s1", "_s2", guess, F.lit(default))).drop("_n0", "_n1", "_n2", "_s0", "_s1", "_s2")


def links(pages: DataFrame, key: str, html: str, base: str | None = None) -> DataFrame:
    """key, pos, href, label, url of every anchor with an href, in order from 0: the label is the text of all that
    is inside, url the href joined to the page's address in column `base`."""
    found = elements(pages, key, html, ["a"], base).withColumn("href", F.col("attributes")["href"]).filter("href IS NOT NULL")
    return found.select(key, "pos", "href", F.col("text").alias("label"), "url")


def options(pages: DataFrame, key: str, html: str, skip: str = "All", select: str | None = None) -> DataFrame:
    """key, pos, value, label of a page's options that have both, but the one of value `skip`; of the
    selections of that name only, if one is given."""
    found = elements(pages, key, html, ["option"])
    if select is not None:
        found = found.filter(F.col("select_name") == select)
    rows = found.select(key, "pos", F.trim(F.col("attributes")["value"]).alias("value"), F.col("text").alias("label"))
    return rows.filter((F.col("value") != skip) & (F.col("value") != "") & (F.col("label") != ""))


def table_row_links(pages: DataFrame, key: str, html: str, path: str) -> DataFrame:
    """key, row, href, year, label of each table row of a page: the third cell has the year (its time's text, or
    the start of its datetime), the fourth the first link whose address holds `path`. A row of under four cells
    has none of them, one without such a link an empty label."""
    found = elements(pages, key, html, ["tr", "td", "time", "a"]).filter("row >= 0")
    href = F.trim(F.col("attributes")["href"])
    fits = (F.col("tag") == "a") & (F.col("cell") == 3) & F.contains(href, F.lit(path))
    dated = F.substring(F.trim(F.col("attributes")["datetime"]), 1, 4)
    shown = F.when(F.col("text").rlike("^[0-9]+$"), F.col("text")).when(dated.rlike("^[0-9]{4}$"), dated).try_cast("int")
    own = found.groupBy(key, "row").agg(
        F.count_if(F.col("tag") == "td").alias("_cells"),
        F.min(F.when(fits, F.struct("pos", href.alias("href"), F.col("text").alias("label")))).alias("_a"),
        F.min_by(shown, F.when((F.col("tag") == "time") & (F.col("cell") == 2), F.col("pos"))).alias("_y"),
    )
    whole = F.col("_cells") >= 4
    return own.select(key, "row", F.when(whole, F.col("_a.href")).alias("href"), F.when(whole, F.col("_y")).alias("year"), F.coalesce(F.when(whole, F.col("_a.label")), F.lit("")).alias("label"))


def listed_issuers(found: DataFrame, path: str) -> DataFrame:
    """code, label of the links (page, pos, href, label) of a list in pages from 0: those under `path` whose last
    segment is a number and whose label has two characters or more. The code is the label in lower case with
    white space collapsed; of equal ones the first link counts. The list ends before the first later page that
    adds none."""
    tail = F.regexp_extract(F.rtrim(F.col("href"), F.lit("/")), r"/([^/]*)$", 1)
    label = F.trim("label")
    fine = F.contains("href", F.lit(path)) & tail.rlike("^[0-9]+$") & (F.length(label) >= 2)
    code = F.lower(F.regexp_replace(label, r"\s+", " "))
    first = found.filter(fine).groupBy(code.alias("code")).agg(F.min(F.struct("page", "pos", label.alias("label"))).alias("r"))
    rows = first.select("code", "r.label", "r.page")
    adds = found.select("page").distinct().join(rows.select("page").distinct(), "page", "left_anti").filter("page > 0")
    end = adds.agg(F.min("page").alias("_end"))  # one row
    return rows.join(F.broadcast(end)).filter("_end IS NULL OR page < _end").select("code", "label").orderBy(F.lower("label"), "code")


def merged_issuers(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """code, label of both lists by code in lower case; the fresh one wins."""
    both = stored.select("code", "label", F.lit(0).alias("_o")).unionByName(fresh.select("code", "label", F.lit(1).alias("_o")))
    last = F.max_by(F.struct("code", "label"), F.struct("_o", "code", "label")).alias("r")
    return both.groupBy(F.lower("code").alias("_k")).agg(last).select("r.*")


def first_urls(found: DataFrame, group: list[str], limit: int) -> DataFrame:
    """group, rank, url: the first `limit` distinct urls of search results (group, source_rank, pos, url):
    those of the first source that found any."""
    first = found.groupBy(*group).agg(F.min("source_rank").alias("source_rank"))
    own = join_groups(found, first, [*group, "source_rank"]).groupBy(*group, "url").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("pos", "url"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= limit).select(*group, "rank", "url")


def unwrapped(url: Column) -> Column:
    """The target of a redirect: its uddg parameter or base64 in u=a1..., else the url itself. Tabs and line ends
    within an address don't count, as browsers have it, so base64 may be broken into lines."""
    whole = F.translate(url, "\t\r\n", "")
    query = F.regexp_extract(whole, r"[?&]uddg=([^&#]*)", 1)
    coded = F.regexp_extract(whole, r"[?&]u=a1([A-Za-z0-9_-]+)", 1)
    padded = F.rpad(F.translate(coded, "-_", "+/"), (F.ceil(F.length(coded) / 4) * 4).cast("int"), F.lit("="))
    return F.when(query != "", F.url_decode(query)).when(coded != "", F.try_to_binary(padded, F.lit("base64")).cast("string")).otherwise(url)


def queries_for(issuer: Column, year: Column, report: Column, scope: Column, site: str) -> Column:
    """Search strings for a report, the most exact first."""
    kind = F.when(report == "s1", "rapport semestriel").otherwise("rapport annuel")
    accounts = F.when(scope == "consolidated", "comptes consolides").otherwise("comptes sociaux")
    words = lambda *parts: F.concat_ws(" ", *parts)
    quoted = F.concat(F.lit('"'), issuer, F.lit('"'))
    pdf, there = F.lit("filetype:pdf"), F.lit(f"site:{site}")
    y = year.cast("string")
    return F.array(words(there, quoted, y, kind, pdf), words(there, quoted, y, pdf), words(quoted, kind, y, accounts, pdf), words(quoted, kind, y, pdf), words(issuer, accounts, y, pdf), words(issuer, kind, y), words(issuer, F.lit("etats financiers"), y))


def url_scores(rows: DataFrame, url: Column, issuer: Column, year: Column, scope: Column, report: Column, domain: str) -> DataFrame:
    """Adds strict_score and lenient_score of a url for a request: additive, -100 if it is no PDF, or in strict
    mode of the other kind of report. Accept 40 or more in strict mode, else 35."""
    rows = rows.withColumn("_u", F.lower(F.coalesce(url, F.lit(""))))
    u = F.col("_u")
    rows = with_match(rows, issuer, F.translate(u, "-_", "  "), "_match").withColumns({"_half": any_of(u, HALF_YEAR_IN_URL), "_yearly": any_of(u, ANNUAL_IN_URL)})
    half, yearly, wants_half, joint = F.col("_half"), F.col("_yearly"), report == "s1", F.contains(u, F.lit("consolid"))
    total = F.when(F.contains(u, F.lit(domain)), 40).otherwise(0) + F.when(F.contains(u, year.cast("string")), 20).otherwise(0)
    total = total + F.least("_match", F.lit(40)) + F.when(F.when(wants_half, half).otherwise(yearly), 25).otherwise(0)
    total = total + F.when(joint & (scope == "consolidated"), 8).when(joint & (scope == "statutory"), -8).otherwise(0)
    rows = rows.withColumns({"_total": total, "_other": F.when(wants_half, yearly & ~half).otherwise(half & ~yearly)})
    pdf = F.contains(u, F.lit(".pdf"))
    strict = F.when(~pdf | F.col("_other"), -100).otherwise(F.col("_total"))
    lenient = F.when(~pdf, -100).otherwise(F.col("_total") - F.when(F.col("_other"), 10).otherwise(0))
    return rows.withColumns({"strict_score": strict, "lenient_score": lenient}).drop("_u", "_match", "_half", "_yearly", "_total", "_other")


def pdf_link_score(href: Column, label: Column, year: Column, scope: Column, report: Column) -> Column:
    """Score of a page's link for a request; null if it is no PDF of that year and kind of report."""
    h = F.lower(F.coalesce(href, F.lit("")))
    t = F.translate(F.lower(F.coalesce(label, F.lit(""))), "éè", "ee")
    full, short = year.cast("string"), F.lpad((year % 100).cast("string"), 2, "0")
    alone = lambda c: F.regexp(c, F.concat(F.lit("(^|[^0-9])"), short, F.lit("([^0-9]|$)")))
    dated = F.contains(h, full) | F.contains(t, full) | alone(h) | alone(t)
    either = lambda words: any_of(h, words) | any_of(t, words)
    half, yearly, wants_half = either(HALF_YEAR_IN_LINK), either(ANNUAL_IN_LINK), report == "s1"
    conflict = F.when(wants_half, yearly & ~half).otherwise(half & ~yearly)
    joint = F.contains(h, F.lit("consolid")) | F.contains(t, F.lit("consolid"))
    total = F.when(scope == "consolidated", F.when(joint, 20).otherwise(-12)).otherwise(F.when(joint, -15).otherwise(8))
    points = lambda want, avoid, up: F.when(want, up).otherwise(0) - F.when(avoid, 20).otherwise(0)
    total = total + F.when(wants_half, points(half, yearly, 25)).otherwise(points(yearly, half, 20))
    total = total + F.when(F.contains(t, full) | F.contains(t, short), 3).otherwise(0)
    return F.when(F.endswith(h, F.lit(".pdf")) & dated & ~conflict, total)


def best_link(scored: DataFrame, group: list[str], score: str = "score", least: int = 0) -> DataFrame:
    """The link of each group with the highest score of at least `least`, the first on ties."""
    fine = scored.filter(F.col(score) >= least)
    columns = [c for c in scored.columns if c not in group]
    return fine.groupBy(*group).agg(F.max_by(F.struct(*columns), F.struct(score, -F.col("pos"))).alias("r")).select(*group, "r.*")


def find_pdf_link(pages: DataFrame, key: str, html: str, base: str, year: Column, scope: Column, report: Column) -> DataFrame:
    """key, pos, href, label, score, url: of each page the link to a PDF that fits its request best (year, scope and
    report are columns of pages), joined to the page's address; pages without one that fits are left out."""
    asked = pages.select(key, year.alias("_year"), scope.alias("_scope"), report.alias("_report"))
    found = join_groups(links(pages, key, html, base), asked, [key])
    score = pdf_link_score(F.col("href"), F.col("label"), F.col("_year"), F.col("_scope"), F.col("_report"))
    return best_link(found.withColumn("score", score).drop("_year", "_scope", "_report"), [key])


def stem_fits(stem: Column, report: Column) -> Column:
    """Whether a file's name doesn't contradict the kind of report."""
    s = F.translate(F.lower(F.coalesce(stem, F.lit(""))), "éè", "ee")
    has = lambda *words: any_of(s, words)
    other = has("rfa") & ~has("rfs", "semestre", "s1", "1er")
    half = ~other & has("rfs", "s1", "semestre", "1er", "juin")
    yearly = ~(has("_s1") | s.rlike("(^|[^a-z])s1([^a-z]|$)")) & ~(has("rfs") & ~has("rfa")) & ~(has("semestre") & ~has("annuel", "rfa"))
    return F.when(report == "s1", half).otherwise(yearly)


def first_pages(pages: DataFrame, document: str, page: str, text: str, n: int = 4) -> DataFrame:
    """document, head: the text of the first n pages by page number."""
    return pages.filter(F.col(page) <= n).groupBy(document).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page, F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("head"))  # n pages at most


def requested_reports(rows: DataFrame, head: Column, url: Column, issuer: Column, year: Column, report: Column) -> DataFrame:
    """Adds fits: whether the first pages or the url name the year and the issuer, and no other kind of
    report alone."""
    rows = with_match(with_match(rows.withColumns({"_t": plain_name(head), "_p": plain_name(url)}), issuer, F.col("_p"), "_in_url"), issuer, F.col("_t"), "_in_head")
    t, u, y = F.col("_t"), F.col("_p"), year.cast("string")
    either = lambda words: any_of(u, words) | any_of(t, words)
    half, yearly = either(HALF_YEAR_IN_REPORT), either(ANNUAL_IN_REPORT)
    conflict = F.when(report == "s1", yearly & ~half).otherwise(half & ~yearly)
    fits = (F.contains(u, y) | F.contains(t, y)) & (F.greatest("_in_url", "_in_head") >= 40) & ~conflict
    return rows.withColumn("fits", fits).drop("_t", "_p", "_in_url", "_in_head")


def overrides(requests: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, url: for each request (issuer, year, report, scope) the first of the override rows (pos, issuer,
    aliases, year, report, scope, url) of the same year and report, whose scope is empty or the same and
    whose name or an alias is one of the issuer's. Rows meet by year, report and name, once for all equal requests
    and with the first row of each scope, so neither many requests nor many rows of a name multiply."""
    fine = rows.filter(F.startswith(F.lower("url"), F.lit("http")))
    names = F.array_distinct(F.concat(F.array(plain_name(F.col("issuer"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), plain_name)))
    first = F.min(F.struct("pos", "url")).alias("r")
    b = fine.select("pos", "url", "year", "report", F.coalesce("scope", F.lit("")).alias("_scope"), F.explode(F.filter(names, lambda n: n != "")).alias("_n")).groupBy("year", "report", "_n", "_scope").agg(first)
    asked = ["issuer", "year", "report", "scope"]
    each = requests.select(asked).distinct()
    a = each.select(*asked, F.explode(aliases(F.col("issuer"))).alias("_n"))
    met = a.join(b, ["year", "report", "_n"]).filter((F.col("_scope") == "") | (F.col("_scope") == F.col("scope")))
    found = met.groupBy(asked).agg(F.min("r").alias("r"))
    every = join_groups(requests.select(key, *asked), found, asked)
    return every.groupBy(key).agg(F.min("r").alias("r")).select(key, "r.url")


def first_success(found: DataFrame, request: str) -> DataFrame:
    """request, strategy, url: of candidates (strategy_rank, strategy, score, accept, url) the first by the
    rank of its strategy, then by score, that reached its strategy's mark."""
    fine = found.filter(F.col("score") >= F.col("accept"))
    best = F.min(F.struct("strategy_rank", (-F.col("score")).alias("_s"), "url", "strategy")).alias("r")
    return fine.groupBy(request).agg(best).select(request, "r.strategy", "r.url")
