"""Page sources. Documents come from files through Spark's binaryFile reader; what parses them is a
function given by the caller, so no parser is a dependency."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import requests


def pdf_pages(spark: SparkSession, path: str, parse: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """pdf_id (the file's stem), page_number from 1, page_text."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("pdf_id").to_pylist(), batch.column("content").to_pylist()):
                pages = [t or "" for t in parse(content)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pages), pa.string()), pa.array(range(1, len(pages) + 1), pa.int32()), pa.array(pages, pa.string())], ["pdf_id", "page_number", "page_text"])

    files = spark.read.format("binaryFile").load(path)
    stem = F.url_decode(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    return files.select(stem.alias("pdf_id"), "content").mapInArrow(run, "pdf_id string, page_number int, page_text string")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files (one value or a list a file); what can't be read becomes nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """path, issuer, year of files named by words and years joined with _: the last token of digits
    only is the year, what stands before it the issuer."""
    files = spark.read.format("binaryFile").load(path).select("path")
    stem = F.url_decode(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    parts = F.split(stem, "_")
    place = F.array_max(F.filter(F.transform(parts, lambda p, i: F.when(p.rlike("^[0-9]+$"), i)), lambda i: i.isNotNull()))
    issuer = F.array_join(F.slice(parts, F.lit(1), F.coalesce(place, F.size(parts))), " ")
    return files.select("path", issuer.alias("issuer"), F.get(parts, place).try_cast("int").alias("year"))


def write_csv(df: DataFrame, path: str, lists: list[str]) -> None:
    """Writes CSV with a header; list columns are joined by '; '."""
    df.select(*(F.array_join(c, "; ").alias(c) if c in lists else F.col(c) for c in df.columns)).write.mode("overwrite").option("header", True).csv(path)


def cached_pages(spark: SparkSession, path: str, schema: str, keys: dict[str, object]) -> DataFrame | None:
    """Rows of a page cache if every row has the given keys, else None; what can't be read is no cache."""
    rows = json_rows(spark, path, schema)
    fits = F.lit(True)
    for k, v in keys.items():
        fits = fits & F.col(k).eqNullSafe(F.lit(v))
    n = rows.agg(F.count("*").alias("n"), F.count_if(fits).alias("fine")).first()
    return rows if n["n"] and n["n"] == n["fine"] else None


def issuers(spark: SparkSession, path: str) -> DataFrame:
    """code, label of a JSON file: a list of objects, or an object with such a list."""
    rows = spark.read.option("multiLine", True).schema("code string, label string, emetteurs array<struct<code:string,label:string>>").json(path)
    inner = F.coalesce("emetteurs", F.array(F.struct("code", "label")))
    return rows.select(F.explode(inner).alias("r")).select("r.code", "r.label").filter("code IS NOT NULL OR label IS NOT NULL")


def sector_map(spark: SparkSession, path: str, sectors: tuple[str, ...] = ("bank", "insurance", "other")) -> DataFrame:
    """name, sector of a JSON object by name; other sectors are left out."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return text.select(F.explode("m").alias("name", "sector")).select(F.trim("name").alias("name"), F.trim("sector").alias("sector")).filter(F.col("sector").isin(*sectors))


def listed(spark: SparkSession, path: str, schema: str, inside: str | None = None) -> DataFrame:
    """pos and the fields of the objects of a JSON file that holds a list, or an object with the list under `inside`,
    in their order; what is no object is left out but keeps its place. A missing file gives no rows, one that isn't
    JSON neither."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    items = F.from_json("value", "array<string>")
    if inside is not None:
        items = F.when(F.ltrim("value").startswith("{"), F.from_json(F.get_json_object("value", f"$.{inside}"), "array<string>")).otherwise(items)
    rows = text.select(F.posexplode(items).alias("pos", "item")).filter(F.col("item").startswith("{"))
    return rows.select("pos", F.from_json("item", schema).alias("r")).select("pos", "r.*")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """pos, issuer, aliases, year, report, scope, url of a file of addresses that are known by hand, as
    linking.overrides() takes them."""
    rows = listed(spark, path, "emetteur string, aliases array<string>, year int, type_rapport string, type_comptes string, url string")
    return rows.select("pos", F.col("emetteur").alias("issuer"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "year", requests.report_type(F.col("type_rapport")).alias("report"), F.when(F.trim("type_comptes") != "", requests.scope(F.col("type_comptes"))).alias("scope"), F.trim("url").alias("url")).filter("url <> ''")


#: A case that a benchmark runs: what is asked for, and the page where it stands.
CASE = "id string, pdf_path string, company string, year int, report_type string, sector string, scope string, target_table string, expected_page int"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """pos and the fields of CASE of a file {"cases": [...]} or of a bare list."""
    return listed(spark, path, CASE, "cases")


def page_images(spark: SparkSession, path: str, pattern: str = r"page_([0-9]+)\.png$") -> DataFrame:
    """page_number, path, length of rendered pages."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.select(F.regexp_extract("path", pattern, 1).try_cast("int").alias("page_number"), "path", "length").filter("page_number IS NOT NULL")


def page_text(pages: DataFrame, spans: str) -> DataFrame:
    """A page's lines from a column of spans (line, pos, x0, y0, x1, y1, text), one row a span."""
    return pages.select("pdf_id", "page_number", F.explode(spans).alias("s")).select("pdf_id", "page_number", "s.*")


def page_index(chunks: DataFrame) -> DataFrame:
    """Adds key: a hash of what an index depends on, so that one can be used again only if nothing changed."""
    body = F.to_json(F.struct(*sorted(c for c in chunks.columns if c != "key")))
    return chunks.withColumn("key", F.sha2(body, 256))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_markdown(report: DataFrame, path: str, title: str, columns: list[str], order: str) -> None:
    """A Markdown table of a report that fits one file: numbers with three digits, one line a row."""
    kinds = dict(report.dtypes)
    cell = lambda c: F.format_string("%.3f", F.col(c)) if kinds[c] in ("double", "float") else F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = f"# {title}\n\n| {' | '.join(columns)} |\n|{'-|' * len(columns)}"
    rows = report.select(F.col(order).alias("o"), line.alias("value")).orderBy("o").select("value")
    first = report.sparkSession.range(1).select(F.lit(head).alias("value"))
    first.union(rows).coalesce(1).write.mode("overwrite").text(path)


def downloaded(files: DataFrame, least: int = 1000) -> DataFrame:
    """path, fine, size_mb: what was fetched is refused under `least` bytes."""
    size = F.length("content")
    return files.select("path", (size >= least).alias("fine"), F.round(size / 1048576, 2).alias("size_mb"))


def encoded(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """key, vector by an encoder that the caller gives; where it fails, null vectors, never a failed task."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            try:
                vectors = encode(texts)
            except Exception:  # noqa: BLE001 - any failure of the model means no vector
                vectors = [None] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(vectors, pa.list_(pa.float32()))], ["key", "vector"])

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, vector array<float>").withColumnRenamed("key", key)


def hashing_encoder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An encoder without a model, for tests: counts of hashed words, of length one."""
    import zlib

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimensions
            for word in text.lower().split():
                v[zlib.crc32(word.encode()) % dimensions] += 1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out

    return encode


def read_tables(crops: DataFrame, key: str, client: Callable[[bytes, str], str]) -> DataFrame:
    """key, answer, error by a vision client that the caller gives, from crops with content and prompt; a
    failure becomes a row with its error, never a failed task."""

    def run(batches):
        for batch in batches:
            answers, errors = [], []
            for content, prompt in zip(batch.column("content").to_pylist(), batch.column("prompt").to_pylist()):
                try:
                    answers.append(client(content, prompt))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["key", "answer", "error"])

    rows = crops.select(F.col(key).cast("string").alias("key"), "content", "prompt")
    return rows.mapInArrow(run, "key string, answer string, error string").withColumnRenamed("key", key)


def base64_image(content) -> object:
    return F.base64(content)


def retry_delays(after: float | None, attempt: int, delays: tuple[float, ...] = (8, 20, 45), most: float = 90) -> float:
    """Seconds to wait before the next try: what the server asks for, within 1 and `most`, else by attempt."""
    return min(max(after, 1.0), most) if after is not None else delays[min(attempt, len(delays) - 1)]


def call_with_keys(call: Callable[[str], str], keys: list[str], sleep: Callable[[float], None], delays: tuple[float, ...] = (8, 20, 45)) -> str:
    """Calls with one key after the other. A refused key (PermissionError) is skipped while there are others;
    where all are busy (BlockingIOError, whose first argument may be the seconds asked for), waits and begins
    again, as often as there are delays."""
    last: Exception = ValueError("no key")
    for attempt in range(len(delays) + 1):
        for key in keys:
            try:
                return call(key)
            except PermissionError as e:
                last = e
                if len(keys) == 1:
                    raise
            except BlockingIOError as e:
                last = e
        if attempt < len(delays) and isinstance(last, BlockingIOError):
            asked = last.args[0] if last.args and isinstance(last.args[0], int | float) else None
            sleep(retry_delays(asked, attempt, delays))
        else:
            break
    raise last
