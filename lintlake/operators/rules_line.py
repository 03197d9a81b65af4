"""Line rules: every rule is a predicate on a line, and all of them share one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.catalog import CUSTOM_PATTERN, RULES
from lintlake.functions.scalars import basename, snippet, trimmed
from lintlake.functions.text import lines_of
from lintlake.operators.detect import SOURCE_EXTS, TEST_INFRA, emit, finding, graded, one, scope, text

# --- Fixed values: patterns and limits -------------------------------------------
QUOTED_SECRET = (
    r"(?i)(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key|private[_-]?key)[a-z0-9_]*[\"']?"
    r"\s*[:=]\s*[\"'][^\"'\s]{8,}[\"']"
)
KNOWN_KEY_SHAPE = r"[\"'](?:sk[-_]|gh[pousr]_|AKIA|xox[bap]-|AIza)"
PLACEHOLDER = r"(?i)changeme|change_me|placeholder|example|your[-_]|xxxx|dummy|sample|todo|\$\{|<[a-z_ -]+>"
PRIVATE_KEY = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
URL_CREDENTIALS = r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"']+:[^\s/@\"']+@"
JDBC_URL = r"(?i)jdbc:[a-z0-9]+:"
UNQUOTED_SECRET = r"(?i)^\s*[a-z0-9_.-]*(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)[a-z0-9_.-]*\s*=\s*[^\s\"'#]{8,}\s*$"
ENV_LIKE_FILE = r"(?:^|/)[^/]*\.env(?:\.[^/]*)?$|\.properties$"
ENV_FILE = r"(?:^|/)(?:[^/]+\.env|\.env(?:\.[^/]+)?)$"
ENV_TEMPLATE = r"\.env\.(?:example|sample|template)$"
COMMENT_LINE = r"^\s*(?://|/\*|\*|#)"

COMMENTED_AUTH = r"//\s*@(?:PreAuthorize|Secured|RolesAllowed)\s*\("
TODO_COMMENT = r"(?i)//\s*(TODO|FIXME|HACK|XXX|WORKAROUND)\b[:\s]*(.*)"
URGENT_TAGS = ["FIXME", "HACK", "XXX"]
DATED_TODO = r"(?i)^\s*(?://|/\*|\*|#).*\b(TODO|FIXME|HACK)\b"
DATE_IN_TEXT = r"\b(\d{4}[-/]\d{2}[-/]\d{2})\b"
DATED_TODO_EXTS = [".ts", ".js", ".java", ".md"]
MIN_TODO_AGE, OLD_TODO_AGE = 90, 365
MAX_TITLE_EXCERPT, AGED_SNIPPET = 80, 140

RUNTIME_PATTERNS = {
    "sync-fs-usage": ("medium", r"\b(readFileSync|writeFileSync|readdirSync|statSync)\("),
    "sync-process-usage": ("high", r"\b(execSync|spawnSync)\("),
    "potential-infinite-loop": ("medium", r"\bwhile\s*\(\s*true\s*\)"),
    "sync-http-in-controller": (
        "medium",
        r"\b[rR]estTemplate\b.*\.(exchange|getForObject|getForEntity|postForObject|postForEntity|put|delete)\s*\(",
    ),
    "sync-mail-in-controller": ("medium", r"\bJavaMailSender\b.*\.send\s*\(|\bmailSender\.send\s*\("),
    "runtime-exec-usage": ("high", r"\bRuntime\.getRuntime\(\)\.exec\s*\("),
}
RUNTIME_TITLES = {
    "sync-fs-usage": "Synchronous file access",
    "sync-process-usage": "Synchronous child process",
    "potential-infinite-loop": "Loop without a bound",
    "sync-http-in-controller": "Synchronous HTTP call",
    "sync-mail-in-controller": "Synchronous mail",
    "runtime-exec-usage": "Process started by the runtime",
}
RUNTIME_SKIP = r"[/\\](?:__tests__|fixtures|test)[/\\]|\.(test|spec)\.[tj]sx?$|Test\.java$"
# -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineRule:
    """A rule on one line. ``on`` limits it to files, ``when`` to lines."""

    name: str
    on: Callable[[Column, Column], Column]
    when: Callable[[Column], Column]
    severity: Callable[[Column], Column]
    title: Callable[[Column, Column], Column]
    known: tuple | None = None
    snippet_size: int = 120

    def hit(self) -> Column:
        path, ext, line = F.col("path"), F.col("ext"), F.col("line")
        return F.when(
            self.on(path, ext) & self.when(line),
            finding(
                self.name,
                self.severity(line),
                self.title(path, line),
                one(path, F.col("line_no"), snippet(line, self.snippet_size)),
                self.known or RULES[self.name],
            ),
        )


def _anywhere(path: Column, ext: Column) -> Column:
    return F.lit(True)


def _named(label: str) -> Callable[[Column, Column], Column]:
    return lambda path, line: text(f"{label}: ", path)


def _fixed(severity: str) -> Callable[[Column], Column]:
    return lambda line: F.lit(severity)


def secret_rules() -> list[LineRule]:
    def secret(line: Column) -> Column:
        return line.rlike(QUOTED_SECRET) & ~line.rlike(PLACEHOLDER) & ~line.rlike(COMMENT_LINE)

    return [
        LineRule(
            "no-hardcoded-secret",
            _anywhere,
            secret,
            lambda line: F.when(line.rlike(KNOWN_KEY_SHAPE), F.lit("critical")).otherwise(F.lit("high")),
            _named("Hardcoded secret"),
        ),
        LineRule("no-private-key", _anywhere, lambda l: l.rlike(PRIVATE_KEY), _fixed("critical"), _named("Private key")),
        LineRule(
            "no-connection-string",
            _anywhere,
            lambda l: l.rlike(URL_CREDENTIALS) | l.rlike(JDBC_URL),
            _fixed("high"),
            _named("Connection string"),
        ),
        LineRule(
            "no-hardcoded-secret-unquoted",
            lambda path, ext: path.rlike(ENV_LIKE_FILE),
            lambda l: l.rlike(UNQUOTED_SECRET) & ~l.rlike(PLACEHOLDER),
            _fixed("high"),
            _named("Unquoted secret"),
        ),
    ]


def auth_rules() -> list[LineRule]:
    return [
        LineRule(
            "no-commented-auth",
            lambda path, ext: ext == ".java",
            lambda l: l.rlike(COMMENTED_AUTH),
            _fixed("high"),
            _named("Authorization annotation is commented out"),
        )
    ]


def todo_rules(as_of: Column | None = None) -> list[LineRule]:
    def tag(line: Column) -> Column:
        return F.upper(F.regexp_extract(line, TODO_COMMENT, 1))

    def title(path: Column, line: Column) -> Column:
        message = trimmed(F.regexp_extract(line, TODO_COMMENT, 2))
        shown = F.when(message == "", F.lit("(no description)")).otherwise(message)
        return text(tag(line), " comment: ", F.substring(shown, 1, MAX_TITLE_EXCERPT))

    rules = [
        LineRule(
            "unresolved-todo",
            lambda path, ext: ext.isin(SOURCE_EXTS) & ~path.rlike(TEST_INFRA),
            lambda l: l.rlike(TODO_COMMENT),
            lambda l: F.when(tag(l).isin(URGENT_TAGS), F.lit("medium")).otherwise(F.lit("low")),
            title,
        )
    ]
    if as_of is not None:

        def age(line: Column) -> Column:
            # Days 29..31 of a shorter month count on into the next one.
            day = F.replace(F.regexp_extract(line, DATE_IN_TEXT, 1), F.lit("/"), F.lit("-"))
            month = F.try_to_date(F.concat(F.substring(day, 1, 7), F.lit("-01")), "yyyy-MM-dd")
            number = F.substring(day, 9, 2).try_cast("int")
            return F.when(number.between(1, 31), F.datediff(as_of, F.date_add(month, number - 1)))

        rules.append(
            LineRule(
                "aged-todo",
                lambda path, ext: ext.isin(DATED_TODO_EXTS),
                lambda l: l.rlike(DATED_TODO) & F.coalesce(age(l) >= MIN_TODO_AGE, F.lit(False)),
                lambda l: graded(age(l), {"high": OLD_TODO_AGE}, "medium"),
                lambda path, l: text("Note left for ", age(l), " days: ", path),
                snippet_size=AGED_SNIPPET,
            )
        )
    return rules


def runtime_rules() -> list[LineRule]:
    def on(path: Column, ext: Column) -> Column:
        return ext.isin(SOURCE_EXTS) & ~F.concat(F.lit("/"), path).rlike(RUNTIME_SKIP)

    def rule(name: str, severity: str, pattern: str) -> LineRule:
        return LineRule(name, on, lambda l: l.rlike(pattern), _fixed(severity), _named(RUNTIME_TITLES[name]))

    return [rule(name, severity, pattern) for name, (severity, pattern) in RUNTIME_PATTERNS.items()]


def custom_rules(patterns) -> list[LineRule]:
    """User patterns ``(rule, regex, severity)``, compiled as literals like the built-in ones."""

    def rule(name: str, pattern: str, severity: str) -> LineRule:
        return LineRule(
            name, _anywhere, lambda l: l.rlike(pattern), _fixed(severity), _named(f"Pattern {name}"), CUSTOM_PATTERN
        )

    return [rule(*p) for p in patterns]


def numbered_lines(files: DataFrame) -> DataFrame:
    """``(repo, path, ext, line_no, line)``; line numbers start at 1 and a trailing empty line counts."""
    return files.select("repo", "path", "ext", F.posexplode(lines_of(F.col("content"))).alias("_i", "line")).select(
        "repo", "path", "ext", (F.col("_i") + 1).alias("line_no"), "line"
    )


def detect_on_lines(lines: DataFrame, rules: list[LineRule]) -> DataFrame:
    return emit(lines, *[r.hit() for r in rules])


def line_rules(files: DataFrame, as_of: Column | None = None, patterns=(), dot: bool = True) -> DataFrame:
    """All line rules in one pass over the text; nothing is shuffled."""
    rules = secret_rules() + auth_rules() + todo_rules(as_of) + runtime_rules() + custom_rules(patterns)
    return detect_on_lines(numbered_lines(scope(files, dot=dot)), rules)


def secrets(files: DataFrame, patterns=()) -> DataFrame:
    return detect_on_lines(numbered_lines(scope(files, dot=True)), secret_rules() + custom_rules(patterns))


def todos(files: DataFrame, as_of: Column | None = None) -> DataFrame:
    exts = DATED_TODO_EXTS if as_of is not None else SOURCE_EXTS
    return detect_on_lines(numbered_lines(scope(files, exts)), todo_rules(as_of))


def runtime_calls(files: DataFrame) -> DataFrame:
    return detect_on_lines(numbered_lines(scope(files, SOURCE_EXTS)), runtime_rules())


def committed_env_files(files: DataFrame) -> DataFrame:
    path = F.col("path")
    hits = scope(files, dot=True).where(path.rlike(ENV_FILE) & ~path.rlike(ENV_TEMPLATE))
    return emit(
        hits,
        finding("no-env-file-committed", "high", text("Environment file in the repository: ", basename(path)), one(path)),
    )
