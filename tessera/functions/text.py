"""Scalar functions on names, paths, routes, documentation and scores: Column to Column, JVM-side.

Null gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace prefixes and type names that are noise in call and dependency results.
NOISE_PREFIXES = ("System.", "Microsoft.", "StackExchange.", "Npgsql.", "Polly.", "MediatR.", "Serilog.", "Newtonsoft.", "Qdrant.")
NOISE_NAMES = (
    "string", "int", "long", "short", "byte", "sbyte", "uint", "ulong", "ushort", "float", "double", "decimal", "bool", "char", "object", "void",
    "string?", "int?", "long?", "bool?", "double?", "decimal?", "DateTime", "Guid", "TimeSpan", "DateTimeOffset",
)
# File extension to language.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python",
    ".java": "java", ".go": "go", ".rs": "rust", ".php": "php", ".cs": "csharp",
}
# Directories that a scan leaves out.
EXCLUDED_DIRS = (
    "node_modules", ".git", "dist", "build", ".next", ".turbo", ".nuxt", ".svelte-kit", ".angular", ".output", "coverage",
    "bin", "obj", "__pycache__", ".venv", "venv", "target", ".gradle", "vendor",
)
# Kinds of symbols that get an embedding.
EMBEDDABLE = ("class", "method", "interface", "struct", "record", "function", "type", "document", "section")
# Scale in days of the decay of a memory, by topic; a session memory has one day, any other topic sixty.
TOPIC_DAYS = {"preference": 365, "pattern": 180, "decision": 180, "bug": 90, "todo": 30, "note": 60}
# Shapes of well-known keys, and of keyword forms.
SECRETS = (
    r"AIzaSy[0-9A-Za-z_-]{33}",
    r"sk-ant-[0-9A-Za-z_-]{20,}",
    r"sk-(?:proj-)?[0-9A-Za-z_-]{20,}",
    r"gh[pousr]_[0-9A-Za-z]{36,}",
    r"AKIA[0-9A-Z]{16}",
    r"eyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]*",
    r"(?i)\b(?:api[_-]?key|token|secret|password|pwd)\s*[=:]\s*[\"']?[^\s\"';,]{8,}",
    r"(?i)\bbearer\s+[0-9a-z._~+/-]{16,}",
)
REDACTED = "[REDACTED_API_KEY]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- names ----


def without_params(fqn: Column | str) -> Column:
    """The fqn up to its parameter list."""
    fqn = _c(fqn)
    return F.when(F.instr(fqn, "(") > 1, F.substring_index(fqn, "(", 1)).otherwise(fqn)


def method_name(fqn: Column | str) -> Column:
    """the last dotted segment, without parameters."""
    return F.substring_index(without_params(fqn), ".", -1)


def containing_type(fqn: Column | str) -> Column:
    """what stands before the last dot, without parameters; empty where there is none."""
    return F.regexp_extract(without_params(fqn), r"(?s)^(.*)\.[^.]*$", 1)


#: Nesting of type arguments that is folded.
NESTING = 8


def normalize_generics(s: Column | str) -> Column:
    """every outermost ``<...>`` becomes ``<T>``; nested ones fold from inside."""
    out = _c(s)
    for _ in range(NESTING):
        out = F.regexp_replace(out, "<[^<>]*>", "\u0001")
    return F.regexp_replace(out, "\u0001", "<T>")


def infer_kind(fqn: Column | str) -> Column:
    """the kind that the spelling of an fqn suggests."""
    fqn = _c(fqn)
    return (
        F.when(fqn.startswith("DI:"), "di_registration")
        .when(fqn.startswith("API:"), "api_endpoint")
        .when(fqn.startswith("config:") | fqn.startswith("env:"), "config_key")
        .when(fqn.startswith("doc:"), F.when(fqn.contains("#"), "section").otherwise("document"))
        .when(fqn.contains("("), "method")
        .when(fqn.rlike(r"\.I\p{Lu}[^.]*$"), "interface")
        .when(fqn.isNotNull(), "class")
    )


def sanitize_label(s: Column | str, empty: str = "Unknown") -> Column:
    """letters, digits and ``_`` only; ``empty`` where nothing is left or there was nothing."""
    kept = F.regexp_replace(F.coalesce(_c(s), F.lit("")), r"[^\p{L}\p{Nd}_]", "")
    return F.when(kept == "", empty).otherwise(kept)


def is_noise(fqn: Column | str) -> Column:
    """A framework or primitive name; false for null and empty."""
    fqn = F.coalesce(_c(fqn), F.lit(""))
    out = fqn.isin(*NOISE_NAMES)
    for p in NOISE_PREFIXES:
        out = out | fqn.startswith(p)
    return out


def is_bare_name(s: Column | str) -> Column:
    """a name without ``:``, ``.``, ``(`` or ``/``."""
    return ~_c(s).rlike(r"[:.(/]")


def is_pascal(s: Column | str) -> Column:
    """begins with a capital, has a small letter and at least two capitals."""
    s = _c(s)
    return s.rlike(r"^\p{Lu}") & s.rlike(r"\p{Ll}") & (F.length(F.regexp_replace(s, r"[^\p{Lu}]", "")) >= 2)


def is_camel(s: Column | str) -> Column:
    """begins with a small letter and has a capital."""
    s = _c(s)
    return s.rlike(r"^\p{Ll}") & s.rlike(r"\p{Lu}") & (F.length(s) >= 2)


def module_of(fqn: Column | str) -> Column:
    """the module part of ``path:Name.member``."""
    return F.substring_index(_c(fqn), ":", 1)


def member_of(fqn: Column | str) -> Column:
    """the part after the module; empty where there is none."""
    fqn = _c(fqn)
    return F.when(fqn.contains(":"), F.regexp_replace(fqn, r"^[^:]*:", "")).otherwise(F.when(fqn.isNotNull(), ""))


def matches_member(c: Column | str, fqn: str) -> Column:
    """The fqn itself or one of its signatures."""
    c = _c(c)
    return (c == fqn) | c.startswith(fqn + "(")


def matches_generic(c: Column | str, fqn: str) -> Column:
    """The fqn itself or a generic form of it."""
    c = _c(c)
    return (c == fqn) | c.startswith(fqn + "<")


def covers_member(c: Column | str, fqn: str) -> Column:
    """The fqn, a member of it, or one of its signatures."""
    c = _c(c)
    return (c == fqn) | c.startswith(fqn + ".") | c.startswith(fqn + "(")


# ---- paths and routes ----


def slashes(path: Column | str) -> Column:
    """forward slashes."""
    return F.translate(_c(path), "\\", "/")


def extension(path: Column | str) -> Column:
    """The extension in small letters, with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(slashes(path), r"(\.[^./]+)$", 1))


def language_of(path: Column | str) -> Column:
    """The language of a path's extension; null for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, extension(path))


def in_excluded_dir(path: Column | str) -> Column:
    """S3: whether a directory of the path is one of :data:`EXCLUDED_DIRS`; false for null."""
    dirs = "|".join(d.replace(".", r"\.") for d in EXCLUDED_DIRS)
    return F.coalesce(slashes(path).rlike(f"/({dirs})/"), F.lit(False))


def is_build_artifact(path: Column | str) -> Column:
    """Below bin, obj, node_modules or .git; false for null."""
    return F.coalesce(slashes(path).rlike(r"/(bin|obj|node_modules|\.git)/"), F.lit(False))


def normalize_route(route: Column | str) -> Column:
    """trimmed, without leading slashes; empty for null and blank."""
    return F.regexp_replace(F.trim(F.coalesce(_c(route), F.lit(""))), "^/+", "")


def join_route(prefix: Column | str, route: Column | str) -> Column:
    """one slash between prefix and route; an empty part leaves the other."""
    p, r = F.rtrim(F.coalesce(_c(prefix), F.lit("")), F.lit("/")), F.ltrim(F.coalesce(_c(route), F.lit("")), F.lit("/"))
    return F.when(p == "", r).when(r == "", p).otherwise(F.concat(p, F.lit("/"), r))


def expand_route(template: Column | str, controller: Column | str, action: Column | str) -> Column:
    """``[controller]`` (class name without its suffix) and ``[action]`` filled in, in any letter case."""
    name = F.regexp_replace(_c(controller), "Controller$", "")
    literal = lambda c: F.regexp_replace(_c(c), r"([\\$])", r"\\$1")
    out = F.regexp_replace(_c(template), F.lit(r"(?i)\[controller\]"), literal(name))
    return F.regexp_replace(out, F.lit(r"(?i)\[action\]"), literal(action))


def normalize_path(path: Column | str) -> Column:
    """``.`` and empty parts dropped, ``..`` takes back the part before it (or nothing at the top)."""
    parts = F.split(slashes(path), "/")
    step = lambda acc, p: (
        F.when(p.isin("", "."), acc).when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def directory_of(path: Column | str) -> Column:
    """the path up to its last slash; empty where there is none."""
    return F.regexp_extract(slashes(path), r"(?s)^(.*)/[^/]*$", 1)


def module_from_path(path: Column | str) -> Column:
    """the first part with a dot that is no ``.cs`` file, else the parent directory, else Unknown."""
    parts = F.split(slashes(F.coalesce(_c(path), F.lit(""))), "/")
    dotted = F.filter(parts, lambda p: p.contains(".") & ~p.endswith(".cs"))
    parent = F.when(F.size(parts) >= 2, F.element_at(parts, F.greatest(F.size(parts) - 1, F.lit(1))))
    return F.when(F.size(dotted) > 0, F.element_at(dotted, F.lit(1))).otherwise(F.coalesce(F.nullif(parent, F.lit("")), F.lit("Unknown")))


def endpoint_method(fqn: Column | str) -> Column:
    """the verb of ``API:VERB:route``."""
    return F.regexp_extract(_c(fqn), r"^API:([^:]*):", 1)


def endpoint_route(fqn: Column | str) -> Column:
    """the route of ``API:VERB:route``."""
    return F.regexp_extract(_c(fqn), r"(?s)^API:[^:]*:(.*)$", 1)


def slug(s: Column | str) -> Column:
    """small letters, spaces to dashes, then one pass each over ``---`` and ``--``, no dash at either end."""
    out = F.replace(F.lower(_c(s)), F.lit(" "), F.lit("-"))
    out = F.replace(F.replace(out, F.lit("---"), F.lit("-")), F.lit("--"), F.lit("-"))
    return F.regexp_replace(out, "^-+|-+$", "")


# ---- values ----


def unquote(s: Column | str) -> Column:
    """F8: without the double quotes around it."""
    return F.regexp_replace(_c(s), r'(?s)^"(.*)"$', "$1")


def int_or_zero(s: Column | str) -> Column:
    """F8: a whole number, 0 where the text is none."""
    return F.coalesce(F.trim(_c(s)).try_cast("int"), F.lit(0))


def strip_quotes(s: Column | str) -> Column:
    """without a pair of equal quotes of any of three kinds around it."""
    return F.regexp_replace(_c(s), r"""(?s)^(?:"(.*)"|'(.*)'|`(.*)`)$""", "$1$2$3")


def truncated(s: Column | str, n: int) -> Column:
    """at most ``n`` characters, and ``...`` where more were cut."""
    s = _c(s)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def sanitize_term(s: Column | str) -> Column:
    """ASCII letters, digits and ``_`` only."""
    return F.regexp_replace(_c(s), "[^a-zA-Z0-9_]", "")


def is_env_key(s: Column | str) -> Column:
    """a letter or ``_``, then letters, digits or ``_``."""
    return _c(s).rlike(r"^[\p{L}_][\p{L}\p{Nd}_]*$")


def same_name(a: Column | str, b: Column | str) -> Column:
    """equal without case."""
    return F.lower(_c(a)) == F.lower(_c(b))


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the UTF-8 bytes in capital hex digits."""
    return F.upper(F.sha2(_c(text), 256))


def requirement_name(spec: Column | str) -> Column:
    """the package of a requirement, without extras."""
    return F.trim(F.regexp_replace(F.regexp_extract(_c(spec), r"^([^=><~!\t @]*)", 1), r"\[.*\]", ""))


def requirement_version(spec: Column | str) -> Column:
    """what follows the package, ``*`` for nothing."""
    rest = F.trim(F.regexp_replace(_c(spec), r"^[^=><~!\t @]*", ""))
    return F.when(rest == "", "*").otherwise(rest)


def lifetime(registration: Column | str) -> Column:
    """Scoped, Transient, Singleton ... from AddScoped, TryAddTransient, ...; Unknown for others."""
    x = F.regexp_extract(_c(registration), r"^(?:Try)?Add(Scoped|Transient|Singleton|HostedService|HttpClient)", 1)
    return F.when(x == "", "Unknown").otherwise(x)


def short_type(name: Column | str) -> Column:
    """the last dotted part of a type name, type arguments folded."""
    return F.substring_index(normalize_generics(name), ".", -1)


# ---- documentation ----


def clean_doc_comment(doc: Column | str) -> Column:
    """the lines of a block comment without marks, tag lines dropped, joined by one space."""
    body = F.regexp_replace(F.regexp_replace(_c(doc), r"^\s*/\*+", ""), r"\*+/\s*$", "")
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:\*+|///?)?\s?", "")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("@")), " ")


def clean_docstring(doc: Column | str) -> Column:
    """the first part of a docstring without quotes: up to a section head, a field, or a blank line."""
    body = F.trim(F.regexp_replace(_c(doc), r"^\s*(?:\"\"\"|''')|(?:\"\"\"|''')\s*$", ""))
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x))
    stop = F.transform(lines, lambda x: x.startswith(":") | x.rlike(r"^(Args|Arguments|Parameters|Params|Returns|Return|Raises|Yields|Examples?|Notes?)\s*:"))
    at = F.array_position(stop, F.lit(True))
    kept = F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)
    return F.array_join(F.filter(kept, lambda x: x != ""), " ")


def xml_summary(doc: Column | str) -> Column:
    """F32: the text of a summary element, tags dropped, white space folded; empty where there is none."""
    inner = F.regexp_extract(_c(doc), r"(?s)<summary>(.*?)</summary>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", ""), r"(?m)^\s*///", " "), r"\s+", " "))


def embedding_text(kind: Column | str, fqn: Column | str, signature: Column | str, documentation: Column | str) -> Column:
    """what is embedded of a symbol: kind and signature or fqn, then its documentation on a new line."""
    sig = F.nullif(F.trim(_c(signature)), F.lit(""))
    head = F.concat_ws(" ", F.lower(_c(kind)), F.coalesce(sig, _c(fqn)))
    return F.concat_ws("\n", head, F.nullif(F.trim(_c(documentation)), F.lit("")))


def has_secret(text: Column | str) -> Column:
    """whether a text holds something that looks like a key or password; false for null."""
    out = F.lit(False)
    for p in SECRETS:
        out = out | F.coalesce(_c(text).rlike(p), F.lit(False))
    return out


def redact(text: Column | str) -> Column:
    """every such part replaced by :data:`REDACTED`."""
    out = _c(text)
    for p in SECRETS:
        out = F.regexp_replace(out, p, REDACTED)
    return out


# ---- scores and times ----


def decay_days(scope: Column | str, topic: Column | str) -> Column:
    """the scale of a memory's decay in days."""
    topic = _c(topic)
    out = F.when(F.lower(F.trim(_c(scope))) == "session", 1)
    for t, days in TOPIC_DAYS.items():
        out = out.when(topic == t, days)
    return out.otherwise(60)


def decay_score(importance: Column | str, age_seconds: Column, days: Column) -> Column:
    """importance weakened by a Weibull decay of shape 1.5; ages below zero count as zero."""
    age = F.greatest(F.lit(0.0), age_seconds.cast("double"))
    return _c(importance).cast("double") * F.exp(-F.pow(age / (F.lit(86400.0) * days), F.lit(1.5)))


def cosine(a: Column, b: Column) -> Column:
    """cosine similarity of two vectors of doubles; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def age_text(seconds: Column) -> Column:
    """whole days from one day on, else whole hours; singular for one."""
    unit = lambda n, word: F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {word}")).otherwise(F.lit(f" {word}s")))
    days, hours = F.floor(seconds / 86400), F.floor(seconds / 3600)
    return F.when(days >= 1, unit(days, "day")).otherwise(unit(hours, "hour"))


def index_age_label(seconds: Column) -> Column:
    """(never) for null, null below six hours, else the age."""
    return F.when(seconds.isNull(), "(never)").when(seconds >= 6 * 3600, F.concat(age_text(seconds), F.lit(" ago")))


def strip_json_comments(s: Column | str) -> Column:
    """line and block comments outside strings dropped."""
    return F.regexp_replace(_c(s), r'(?s)("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', "$1")


def toml_section(line: Column | str) -> Column:
    """the name of a section head, empty for other lines."""
    return F.trim(F.regexp_extract(_c(line), r"^\s*\[\[?([^\[\]]+)\]\]?\s*(?:#.*)?$", 1))


def toml_key(line: Column | str) -> Column:
    """the key of an assignment, quotes dropped; empty for other lines."""
    return F.regexp_replace(F.trim(F.regexp_extract(_c(line), r"^\s*([\w.\"'-]+)\s*=", 1)), "[\"']", "")


def toml_value(line: Column | str) -> Column:
    """the value of an assignment, a comment outside quotes dropped; empty for other lines."""
    return F.trim(F.regexp_extract(_c(line), r"^\s*[\w.\"'-]+\s*=\s*((?:\"[^\"]*\"|'[^']*'|[^#\"'])*)", 1))
