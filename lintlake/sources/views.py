"""Audit-shaped views over the benchmark tables.

The tables hold orders, events, documents and pages. These views give them the
shape of audit input by row-wise projection, so their size follows the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.catalog import ID_PREFIX
from lintlake.functions.scalars import lookup
from lintlake.schema import DOMAINS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan to the number of partitions that the session asks for, if it does.

    Scans are split by ``spark.sql.files.maxPartitionBytes``, but not below a row group: a bench on tables
    of one row group each sets ``lintlake.scan.partitions``. It says nothing about sizes, and is off by default.
    """
    wanted = df.sparkSession.conf.get("lintlake.scan.partitions", None)
    return df.repartition(int(wanted)) if wanted else df


def events_as_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per event; every thirteenth also names a vendored second place."""
    e = spread(table(spark, sf_dir, "events"))
    n = F.col("event_id")
    domain = F.element_at(
        F.array(*[F.lit(d) for d in DOMAINS]),
        (((F.floor(n / 12) + F.col("user_id")) % 12) + 1).cast("int"),
    )
    rule = F.expr(
        "CASE event_type WHEN 'view' THEN 'file-too-long' WHEN 'click' THEN 'excessive-file-length' "
        "WHEN 'error' THEN 'hardcoded-secret' WHEN 'signup' THEN 'no-hardcoded-secret' ELSE 'magic-number' END"
    )
    severity = F.expr(
        "CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'high' "
        "WHEN value >= 40 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'info' END"
    )
    file = F.expr(
        "CASE WHEN event_id % 17 = 0 THEN 'package.json' "
        "WHEN event_id % 11 = 0 THEN concat('src/__tests__/f', event_id % 4, '.ts') "
        "ELSE concat('src/m', event_id % 3, '/f', event_id % 4, '.ts') END"
    )
    first = F.struct(
        file.alias("file"),
        (n % 8 + 1).cast("int").alias("line"),
        F.when(n % 3 == 0, F.col("props")).alias("snippet"),
    )
    second = F.struct(
        F.lit("vendor/lib.js").alias("file"),
        F.lit(None).cast("int").alias("line"),
        F.lit(None).cast("string").alias("snippet"),
    )
    base = e.select(
        n.alias("seq"),
        F.concat(F.lit("repo"), F.col("user_id")).alias("repo"),
        domain.alias("domain"),
        rule.alias("rule"),
        severity.alias("severity"),
        (((n * 37) % 101).cast("double") / 100).alias("confidence"),
        F.when(n % 13 == 0, F.array(first, second)).otherwise(F.array(first)).alias("evidence"),
        F.to_date("ts").alias("run_date"),
        F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int").alias("run_no"),
    )
    return base.select(
        "repo",
        "seq",
        F.concat(lookup(F.col("domain"), ID_PREFIX), F.lit("-"), F.lpad((F.col("seq") % 100).cast("string"), 3, "0")).alias("id"),
        "severity",
        F.concat(F.col("rule"), F.lit(" in "), F.col("evidence")[0]["file"]).alias("title"),
        F.lit(None).cast("string").alias("description"),
        "domain",
        "rule",
        "confidence",
        "evidence",
        F.lit(None).cast("string").alias("recommendation"),
        F.lit(None).cast("string").alias("effort"),
        F.array().cast("array<string>").alias("tags"),
        F.lit("tool").alias("source"),
        "run_date",
        "run_no",
    )


def _chosen(templates: list[Column], index: Column) -> Column:
    return F.element_at(F.array(*templates), (index + 1).cast("int"))


def _files_from_documents(spark, sf_dir, repo: Column, path: Column, ext: str, templates) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    doc = F.col("doc_id")
    lines = F.transform(
        F.split("text", "\n"),
        lambda _, i: _chosen(templates(doc, i + 1), (doc * 31 + (i + 1) * 5) % 14),
    )
    return d.select(
        repo.alias("repo"), path.alias("path"), F.lit(ext).alias("ext"), F.array_join(lines, "\n").alias("content")
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script per document, one pseudo-code line per line of text."""
    doc = F.col("doc_id")

    def templates(d: Column, _: Column) -> list[Column]:
        k = ((d * 7) % 50).cast("string")
        return [
            F.concat(F.lit("export function fn"), d.cast("string"), F.lit("(a, b, c, d) {")),
            F.lit("  if (ready && open) {"),
            F.lit("  for (const x of xs) {"),
            F.lit("}"),
            F.lit("// TODO 2023-05-01: tidy up"),
            F.lit("// FIXME later"),
            F.concat(F.lit("import { fn"), k, F.lit(" } from '../services/file"), k, F.lit("';")),
            F.lit("const data = readFileSync(path);"),
            F.lit("while (true) { step(); }"),
            F.concat(F.lit("total += "), (d % 97 + 3).cast("string"), F.lit(" * rate;")),
            F.lit("} catch (err) { }"),
            F.concat(F.lit('const apiToken = "tok_'), (d % 9).cast("string"), F.lit('abcdef0123456789abcdef";')),
            F.lit("router.get('/api/getUsers', handler);"),
            F.lit("new Buffer(16);"),
        ]

    folder = _chosen([F.lit(x) for x in ("controllers", "services", "models", "repositories")], doc % 4)
    path = F.concat(F.lit("src/"), folder, F.lit("/file"), doc.cast("string"), F.lit(".ts"))
    return _files_from_documents(
        spark, sf_dir, F.concat(F.lit("repo"), (doc % 10).cast("string")), path, ".ts", templates
    )


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Java class per document; the line templates cover web, security and persistence code."""
    doc = F.col("doc_id")

    def templates(d: Column, _: Column) -> list[Column]:
        n = d.cast("string")
        k = ((d * 7) % 50).cast("string")
        return [
            F.concat(F.lit("public class File"), n, F.lit(" { @RestController class Web { @Data @Entity class Row {")),
            F.lit("  http.csrf().disable().authorizeRequests().anyRequest().permitAll();"),
            F.lit('  config.addAllowedOrigin("*");'),
            F.lit("  // @PreAuthorize(\"hasRole('ADMIN')\")"),
            F.lit("  public Order create(@RequestBody OrderDto dto) {"),
            F.lit("  @ExceptionHandler(Exception.class)"),
            F.lit("    return ResponseEntity.badRequest().body(e.getMessage()); }"),
            F.lit("  @ManyToOne(cascade = CascadeType.ALL)"),
            F.lit('  @Query("UPDATE Order o SET o.done = true")'),
            F.concat(F.lit("import com.shop.model.File"), k, F.lit(";")),
            F.lit("  public List<Order> findAll() { return restTemplate.getForObject(url, List.class); }"),
            F.lit("  String upload(@RequestParam MultipartFile file, HttpSession session) {"),
            F.lit("  config.setAllowCredentials(true); }}}"),
            F.lit('  @GetMapping("/api/v1/order_items")'),
        ]

    folder = _chosen([F.lit(x) for x in ("controller", "service", "model", "repository")], doc % 4)
    path = F.concat(F.lit("src/main/java/com/shop/"), folder, F.lit("/File"), doc.cast("string"), F.lit(".java"))
    return _files_from_documents(
        spark, sf_dir, F.concat(F.lit("shop"), (doc % 10).cast("string")), path, ".java", templates
    )


def style_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stylesheet per document."""
    doc = F.col("doc_id")

    def templates(d: Column, i: Column) -> list[Column]:
        def px(m):
            return ((d + i) % m).cast("string")

        return [
            F.concat(F.lit(".a { color: #"), F.lpad(((d * 37) % 1000).cast("string"), 3, "0"), F.lit("; }")),
            F.lit(".b { color: #ffffff; background: #000; }"),
            F.concat(F.lit(".c { color: rgb(1, 2, "), px(9), F.lit("); }")),
            F.concat(F.lit("  --main-color: #"), F.lpad((d % 1000).cast("string"), 3, "0"), F.lit(";")),
            F.concat(F.lit(".d { font-family: Face"), px(6), F.lit(", serif; }")),
            F.concat(F.lit(".e { font-size: "), px(20), F.lit("px; }")),
            F.concat(F.lit(".f { z-index: "), (d % 300).cast("string"), F.lit("; }")),
            F.concat(F.lit(".g { box-shadow: 0 0 "), px(8), F.lit("px black; }")),
            F.concat(F.lit(".h { transition: opacity "), px(7), F.lit("00ms; }")),
            F.concat(F.lit("@media (max-width: "), px(9), F.lit("00px) { }")),
            F.lit("@keyframes spin { from { opacity: 0 } }"),
            F.lit(".i { color: var(--main-color); }"),
            F.lit(".j { box-shadow: none; }"),
            F.lit(".k { font-family: inherit; }"),
        ]

    path = F.concat(F.lit("styles/s"), doc.cast("string"), F.lit(".css"))
    return _files_from_documents(
        spark, sf_dir, F.concat(F.lit("site"), (doc % 10).cast("string")), path, ".css", templates
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with a few seeded defects: no lang, no alt, empty buttons, bare inputs."""
    p = spread(table(spark, sf_dir, "pages"))
    n = F.col("page_id")
    without_lang = F.when(n % 5 == 0, F.regexp_replace("html", '<html lang="[a-z]*">', "<html>")).otherwise(F.col("html"))
    seed = _chosen(
        [
            F.lit('<article><img src="a.png">'),
            F.lit('<article><button class="x"></button>'),
            F.lit('<article><input name="a"><input name="b" style="color: red; margin: 0">'),
            F.lit('<article><img src="a.png" alt="a">'),
        ],
        n % 4,
    )
    content = F.replace(without_lang, F.lit("<article>"), seed)
    return p.select(
        F.concat(F.lit("site"), (n % 8).cast("string")).alias("repo"),
        F.concat(F.lit("page"), n.cast("string"), F.lit(".html")).alias("path"),
        F.lit(".html").alias("ext"),
        content.alias("content"),
    )


def component_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as component classes; two of three hold their markup, the others name a file."""
    n = F.regexp_extract("path", "[0-9]+", 0)
    markup = F.when(n.cast("long") % 3 == 0, F.lit("templateUrl: './page.html'")).otherwise(F.concat(F.lit("template: `"), "content", F.lit("`")))
    return page_files(spark, sf_dir).select(
        "repo", F.concat(F.lit("src/page"), n, F.lit(".component.ts")).alias("path"), F.lit(".ts").alias("ext"),
        F.concat(F.lit("@Component({\n  selector: 'app-page',\n  "), markup, F.lit("\n})\nexport class PageComponent {}\n")).alias("content"),
    )


def site_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts next to the pages; three of the eight sites use a translation library."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("site"), (doc % 8).cast("string")).alias("repo"),
        F.concat(F.lit("src/s"), doc.cast("string"), F.lit(".ts")).alias("path"),
        F.lit(".ts").alias("ext"),
        F.when(doc % 8 < 3, F.lit("const { t } = useTranslation();"))
        .when(doc % 8 == 5, F.lit("app.get('/health', ok); initTracer();"))
        .otherwise(F.lit("const a = 1;"))
        .alias("content"),
    )


def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test file per document, with mocks, assertions and skipped blocks by its number."""
    doc = F.col("doc_id")

    def some(cond: Column, line: str) -> Column:
        return F.when(cond, F.lit(line))

    lines = [
        some(doc % 4 != 3, "@Test void works() {"),
        some(doc % 5 == 0, "it.skip('later', run);"),
        some(doc % 3 == 0, "expect(value).toBe(1);"),
        some(doc % 2 == 0, "@SpringBootTest"),
        some(doc % 6 == 0, "@WebMvcTest"),
    ]
    content = F.concat_ws(
        "\n",
        *lines,
        F.repeat(F.lit("jest.mock('a');\n"), (doc % 8).cast("int")),
        F.repeat(F.lit("assertEquals(1, one());\n"), F.when(doc % 7 == 1, F.lit(30)).otherwise(F.lit(0))),
    )
    ext = F.when(doc % 2 == 0, F.lit(".java")).otherwise(F.lit(".ts"))
    name = F.when(doc % 2 == 0, F.concat(F.lit("File"), doc.cast("string"), F.lit("Test.java"))).otherwise(
        F.concat(F.lit("unit-file"), doc.cast("string"), F.lit(".test.ts"))
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("repo"), (doc % 10).cast("string")).alias("repo"),
        F.concat(F.lit("src/tests/"), name).alias("path"),
        ext.alias("ext"),
        content.alias("content"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents themselves, as text files of their source."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        F.col("source").alias("repo"),
        F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit(".md").alias("ext"),
        F.col("text").alias("content"),
    )


def earlier_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of :func:`document_files`: numbers masked, some files missing, some since removed."""
    doc = F.col("doc_id")
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    kept = d.where(doc % 13 != 0).select("source", F.concat(F.lit("docs/d"), doc.cast("string"), F.lit(".md")).alias("path"), "text")
    gone = d.where(doc % 17 == 0).select("source", F.concat(F.lit("docs/old/d"), doc.cast("string"), F.lit(".md")).alias("path"), "text")
    return kept.unionByName(gone).select(
        F.col("source").alias("repo"), "path", F.lit(".md").alias("ext"), F.regexp_replace("text", "[0-9]", "#").alias("content")
    )


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A functional graph over the suppliers, as import edges."""
    s = table(spark, sf_dir, "supplier")
    total = s.agg(F.count(F.lit(1))).scalar()
    target = ((F.col("s_suppkey") * 7 + 3) % total).cast("string")
    return s.select(
        F.lit("suppliers").alias("repo"),
        F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("src"),
        F.concat(F.lit("s"), F.lpad(target, 9, "0")).alias("dst"),
    )
