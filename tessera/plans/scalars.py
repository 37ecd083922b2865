"""Queries of the scalar functions and predicates, each over a whole table, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.tables import micros, table

# table -> key column
_KEYS = {"code_symbols": "id", "relationships": "edge_id", "documents": "doc_id", "file_hashes": "row_id", "agent_memories": "id", "search_results": "result_id"}
QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, t: str, col: Callable[[], Column], sql: str, where: tuple[Callable[[], Column], str] | None = None) -> None:
    """One query: the key of every row of ``t`` and the value."""
    key = _KEYS[t]

    def run(spark, d):
        df = table(spark, d, t)
        if where:
            df = df.where(where[0]())
        return df.select(key, col().alias("value"))

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {key}, {sql} AS value FROM {t}" + (f" WHERE {where[1]}" if where else "")


_BASE = "CASE WHEN instr(fqn, '(') > 1 THEN split_part(fqn, '(', 1) ELSE fqn END"
_SL = "replace(file_path, '\\', '/')"
_FOLD = "signature"
for _ in range(X.NESTING):
    _FOLD = f"regexp_replace({_FOLD}, '<[^<>]*>', chr(1), 'g')"
_FOLD = f"replace({_FOLD}, chr(1), '<T>')"
_NOISE = "coalesce({c}, '') IN (" + ", ".join(f"'{n}'" for n in X.NOISE_NAMES) + ")" + "".join(f" OR starts_with(coalesce({{c}}, ''), '{p}')" for p in X.NOISE_PREFIXES)
_LANG = "CASE regexp_extract(lower(" + _SL + "), '(\\.[^./]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items()) + " END"
_DIRS = "|".join(d.replace(".", "\\.") for d in X.EXCLUDED_DIRS)
_DAYS = "CASE WHEN lower(trim(scope)) = 'session' THEN 1 " + " ".join(f"WHEN topic = '{t}' THEN {n}" for t, n in X.TOPIC_DAYS.items()) + " ELSE 60 END"
#: The fixed present of queries that need one.
NOW = "2025-07-01 00:00:00"
_AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed_at)) / 1000000.0::DOUBLE"


def age_seconds() -> Column:
    return (micros(F.lit(NOW).cast("timestamp_ntz")) - micros("last_accessed_at")) / 1e6


_add("f01_method_name", "code_symbols", lambda: X.method_name("fqn"), f"regexp_extract({_BASE}, '[^.]*$')")
_add("f02_containing_type", "code_symbols", lambda: X.containing_type("fqn"), f"regexp_extract({_BASE}, '(?s)^(.*)\\.[^.]*$', 1)")
_add("f03_normalize_generics", "code_symbols", lambda: X.normalize_generics("signature"), _FOLD)
_add(
    "f04_infer_kind",
    "relationships",
    lambda: X.infer_kind("to_fqn"),
    "CASE WHEN starts_with(to_fqn, 'DI:') THEN 'di_registration' WHEN starts_with(to_fqn, 'API:') THEN 'api_endpoint' "
    "WHEN starts_with(to_fqn, 'config:') OR starts_with(to_fqn, 'env:') THEN 'config_key' WHEN starts_with(to_fqn, 'doc:') THEN CASE WHEN contains(to_fqn, '#') THEN 'section' ELSE 'document' END "
    "WHEN contains(to_fqn, '(') THEN 'method' WHEN regexp_matches(to_fqn, '\\.I\\p{Lu}[^.]*$') THEN 'interface' WHEN to_fqn IS NOT NULL THEN 'class' END",
)
_add("f05_normalize_route", "code_symbols", lambda: X.normalize_route(F.concat(F.lit(" //"), X.endpoint_route("fqn"))), "regexp_replace(trim(coalesce(' //' || regexp_extract(fqn, '(?s)^API:[^:]*:(.*)$', 1), '')), '^/+', '')", (lambda: F.col("kind") == "api_endpoint", "kind = 'api_endpoint'"))
_add("f06_sanitize_label", "relationships", lambda: X.sanitize_label("to_fqn"), "CASE WHEN regexp_replace(coalesce(to_fqn, ''), '[^\\p{L}\\p{Nd}_]', '', 'g') = '' THEN 'Unknown' ELSE regexp_replace(coalesce(to_fqn, ''), '[^\\p{L}\\p{Nd}_]', '', 'g') END")
_add("f08_unquote", "code_symbols", lambda: X.unquote(F.concat(F.lit('"'), "name", F.lit('"'))), "regexp_replace('\"' || name || '\"', '(?s)^\"(.*)\"$', '\\1')")
_add("f08_int_or_zero", "relationships", lambda: X.int_or_zero(F.col("metadata")["line"]), "coalesce(TRY_CAST(trim(metadata['line']) AS INTEGER), 0)")
_add(
    "f09_slug",
    "documents",
    lambda: X.slug(F.regexp_extract("text", r"^([^\r\n]*)", 1)),
    "regexp_replace(replace(replace(replace(lower(regexp_extract(text, '^([^\\r\\n]*)', 1)), ' ', '-'), '---', '-'), '--', '-'), '^-+|-+$', '', 'g')",
    (lambda: F.col("text").startswith("#"), "starts_with(text, '#')"),
)
_add(
    "f10_expand_route",
    "code_symbols",
    lambda: X.expand_route(F.lit("api/[Controller]/[action]"), "name", "kind"),
    "replace(replace('api/[Controller]/[action]', '[Controller]', regexp_replace(name, 'Controller$', '')), '[action]', kind)",
)
_add(
    "f11_join_route",
    "code_symbols",
    lambda: X.join_route(F.concat(F.lit("/v1/"), F.lower("kind"), F.lit("/")), F.concat(F.lit("/"), "name")),
    "'/v1/' || lower(kind) || '/' || name",
)
_add(
    "f12_normalize_path",
    "file_hashes",
    lambda: X.normalize_path(F.concat(F.lit("./"), "file_path", F.lit("/../x//./y.cs"))),
    "regexp_replace(replace(file_path, '\\', '/'), '[^/]*$', '') || 'x/y.cs'",
)
_add("f13_directory", "file_hashes", lambda: X.directory_of("file_path"), f"regexp_extract({_SL}, '(?s)^(.*)/[^/]*$', 1)")
_add("f13_module", "code_symbols", lambda: X.module_of("fqn"), "split_part(fqn, ':', 1)")
_add("f13_member", "code_symbols", lambda: X.member_of("fqn"), "CASE WHEN contains(fqn, ':') THEN regexp_replace(fqn, '^[^:]*:', '') WHEN fqn IS NOT NULL THEN '' END")
_add("f14_bare_name", "relationships", lambda: X.is_bare_name("to_fqn"), "NOT regexp_matches(to_fqn, '[:.(/]')")
_add("f15_strip_json_comments", "documents", lambda: X.strip_json_comments(F.concat(F.lit('{"a": "//'), "lang", F.lit('", // note\n/* b */ "n": '), F.col("n_chars").cast("string"), F.lit("}"))), "'{\"a\": \"//' || lang || '\", \n \"n\": ' || n_chars || '}'")
_add("f19_env_key", "code_symbols", lambda: X.is_env_key("name"), "regexp_matches(name, '^[\\p{L}_][\\p{L}\\p{Nd}_]*$')")
_add(
    "f21_requirement",
    "code_symbols",
    lambda: F.concat_ws(" | ", X.requirement_name(F.concat("name", F.lit("[x]>= 1."), "start_line")), X.requirement_version(F.concat("name", F.lit("[x]>= 1."), "start_line"))),
    "name || ' | >= 1.' || start_line",
    (lambda: F.col("start_line").isNotNull() & F.col("name").rlike("^[A-Za-z_]+$"), "start_line IS NOT NULL AND regexp_matches(name, '^[A-Za-z_]+$')"),
)
_add("f29_toml_line", "documents", lambda: F.concat_ws("|", X.toml_section(F.concat(F.lit("[deps."), "lang", F.lit("] # x"))), X.toml_key(F.concat("lang", F.lit(' = "1#2" # y'))), X.toml_value(F.concat("lang", F.lit(' = "1#2" # y')))), "concat_ws('|', 'deps.' || lang, lang, CASE WHEN lang IS NOT NULL THEN '\"1#2\"' END)", (lambda: F.col("lang").isNotNull(), "lang IS NOT NULL"))
_DOCL = "string_split(regexp_replace(regexp_replace(documentation, '^\\s*/\\*+', ''), '\\*+/\\s*$', ''), chr(10))"
_add(
    "f30_clean_doc_comment",
    "code_symbols",
    lambda: X.clean_doc_comment(F.replace("documentation", F.lit("\r"), F.lit(""))),
    "array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace(documentation, chr(13), ''), '^\\s*/\\*+', ''), '\\*+/\\s*$', ''), chr(10)), "
    "lambda x: trim(regexp_replace(x, '^\\s*(?:\\*+|///?)?\\s?', ''), ' ')), lambda x: x <> '' AND NOT starts_with(x, '@')), ' ')",
)
_add(
    "f31_clean_docstring",
    "code_symbols",
    lambda: X.clean_docstring("documentation"),
    "(WITH l AS (SELECT list_transform(string_split(trim(regexp_replace(documentation, '^\\s*\"\"\"|\"\"\"\\s*$', '', 'g')), chr(10)), lambda x: trim(x)) AS a), "
    "p AS (SELECT a, list_position(list_transform(a, lambda x: starts_with(x, ':') OR regexp_matches(x, '^(Args|Arguments|Parameters|Params|Returns|Return|Raises|Yields|Examples?|Notes?)\\s*:')), true) AS i FROM l) "
    "SELECT array_to_string(list_filter(CASE WHEN i > 0 THEN a[1:i - 1] ELSE a END, lambda x: x <> ''), ' ') FROM p)",
    (lambda: F.col("documentation").startswith('"""'), "starts_with(documentation, '\"\"\"')"),
)
_add("f32_xml_summary", "code_symbols", lambda: X.xml_summary("documentation"), "trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(documentation, '(?s)<summary>(.*?)</summary>', 1), '<[^>]*>', '', 'g'), '(?m)^\\s*///', ' ', 'g'), '\\s+', ' ', 'g'))")
_add("f33_embedding_text", "code_symbols", lambda: X.embedding_text("kind", "fqn", "signature", "documentation"), "concat_ws(chr(10), concat_ws(' ', lower(kind), coalesce(nullif(trim(signature, ' '), ''), fqn)), nullif(trim(documentation, ' '), ''))")
_add("f34_content_hash", "documents", lambda: X.content_hash("text"), "upper(sha256(text))")
_add("f35_decay_score", "agent_memories", lambda: F.round(X.decay_score("importance", age_seconds(), X.decay_days("scope", "topic")), 6), f"round(importance::DOUBLE * exp(-pow(greatest(0.0::DOUBLE, {_AGE}) / (86400.0::DOUBLE * ({_DAYS})), 1.5::DOUBLE)), 6)")
_add("f36_decay_days", "agent_memories", lambda: X.decay_days("scope", "topic"), _DAYS)
_add("f38_module_from_path", "code_symbols", lambda: X.module_from_path("file_path"), f"coalesce(list_filter(string_split({_SL}, '/'), lambda p: contains(p, '.') AND NOT ends_with(p, '.cs'))[1], nullif(CASE WHEN len(string_split({_SL}, '/')) >= 2 THEN string_split({_SL}, '/')[-2] END, ''), 'Unknown')")
_add("f39_age_text", "agent_memories", lambda: X.age_text(age_seconds()), f"CASE WHEN floor({_AGE} / 86400) >= 1 THEN floor({_AGE} / 86400)::BIGINT || CASE WHEN floor({_AGE} / 86400) = 1 THEN ' day' ELSE ' days' END ELSE floor({_AGE} / 3600)::BIGINT || CASE WHEN floor({_AGE} / 3600) = 1 THEN ' hour' ELSE ' hours' END END")
_add("f40_short_type", "code_symbols", lambda: X.short_type(F.concat(F.lit("My.Ns.Repo<"), "name", F.lit(">"))), "'Repo<T>'", (lambda: ~F.col("name").rlike("[<>]"), "NOT regexp_matches(name, '[<>]')"))
_add("f41_endpoint_parts", "code_symbols", lambda: F.concat_ws(" ", X.endpoint_method("fqn"), X.endpoint_route("fqn")), "concat_ws(' ', regexp_extract(fqn, '^API:([^:]*):', 1), regexp_extract(fqn, '(?s)^API:[^:]*:(.*)$', 1))")
_add("f42_truncated", "documents", lambda: X.truncated("text", 150), "CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END")
_add("f43_sanitize_term", "code_symbols", lambda: X.sanitize_term("fqn"), "regexp_replace(fqn, '[^a-zA-Z0-9_]', '', 'g')")
_add("f44_name_case", "code_symbols", lambda: F.when(X.is_pascal("name"), "pascal").when(X.is_camel("name"), "camel").otherwise("other"), "CASE WHEN regexp_matches(name, '^\\p{Lu}') AND regexp_matches(name, '\\p{Ll}') AND length(regexp_replace(name, '[^\\p{Lu}]', '', 'g')) >= 2 THEN 'pascal' WHEN regexp_matches(name, '^\\p{Ll}') AND regexp_matches(name, '\\p{Lu}') THEN 'camel' ELSE 'other' END")
_SECRET = " OR ".join(f"coalesce(regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}'), false)" for p in X.SECRETS)
_RED = "x"
for _p in X.SECRETS:
    _RED = f"regexp_replace({_RED}, '{_p.replace(chr(39), chr(39) * 2)}', '{X.REDACTED}', 'g')"
_WITH_KEYS = "text || ' token = ' || repeat('ab12', 10) || ' AKIA' || repeat('Q7', 8) || ' ghp_' || repeat('xY9', 12)"


def _with_keys() -> Column:
    return F.concat("text", F.lit(" token = "), F.repeat(F.lit("ab12"), 10), F.lit(" AKIA"), F.repeat(F.lit("Q7"), 8), F.lit(" ghp_"), F.repeat(F.lit("xY9"), 12))


_add("f45_has_secret", "documents", lambda: X.has_secret("text"), f"(SELECT {_SECRET} FROM (SELECT text AS x))")
_add("f45_redact", "documents", lambda: X.redact(_with_keys()), f"(SELECT {_RED} FROM (SELECT {_WITH_KEYS} AS x))")
_add("f46_slashes", "file_hashes", lambda: X.slashes("file_path"), _SL)
_add("f47_strip_quotes", "code_symbols", lambda: X.strip_quotes(F.concat(F.lit("'"), "name", F.lit("'"))), "name")
_add("f48_lifetime", "code_symbols", lambda: X.lifetime(F.concat(F.element_at(F.array(F.lit("AddScoped"), F.lit("TryAddSingleton"), F.lit("Bind")), (F.col("id") % 3 + 1).cast("int")), F.lit("<T>"))), "CASE id % 3 WHEN 0 THEN 'Scoped' WHEN 1 THEN 'Singleton' ELSE 'Unknown' END")
_add("f49_same_name", "code_symbols", lambda: X.same_name("kind", F.lit("METHOD")), "lower(kind) = 'method'")
_add("f50_constant_value", "code_symbols", lambda: X.truncated("documentation", 100), "CASE WHEN length(documentation) > 100 THEN substring(documentation, 1, 100) || '...' ELSE documentation END")

_add("src02_language", "code_symbols", lambda: X.language_of("file_path"), _LANG)
_add("src03_excluded_dir", "file_hashes", lambda: X.in_excluded_dir(F.concat(F.lit("/r/"), "file_path")), f"coalesce(regexp_matches(replace('/r/' || file_path, '\\', '/'), '/({_DIRS})/'), false)")
_add("src17_build_artifact", "file_hashes", lambda: X.is_build_artifact(F.concat(F.lit("/obj/"), "file_path")), "file_path IS NOT NULL")

_add("sel09_noise", "relationships", lambda: X.is_noise("to_fqn"), _NOISE.format(c="to_fqn"))
_add("sel16_null_values", "code_symbols", lambda: F.concat_ws("|", F.nullif("signature", F.lit("")), F.nullif("start_line", F.lit(0)).cast("string")), "concat_ws('|', nullif(signature, ''), nullif(start_line, 0))")
_add(
    "sel18_memory_valid",
    "agent_memories",
    lambda: (F.lower(F.trim("scope")).isin("session", "project", "global") & F.coalesce(F.length(F.trim("content")).between(1, 4000), F.lit(False)) & F.coalesce(F.col("importance").between(0, 1), F.lit(False)) & ((F.lower(F.trim("scope")) == "global") | F.coalesce(F.trim("scope_id") != "", F.lit(False)))),
    "lower(trim(scope)) IN ('session', 'project', 'global') AND coalesce(length(trim(content)) BETWEEN 1 AND 4000, false) AND coalesce(importance BETWEEN 0 AND 1, false) AND (lower(trim(scope)) = 'global' OR coalesce(trim(scope_id) <> '', false))",
)
