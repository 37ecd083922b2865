"""The scalar functions and the extractor under names that SQL can call."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# name: (parameters, result, body); SQL all the way, so Catalyst inlines them
# fmt: off
FUNCTIONS = {
    "method_name": ("s STRING", "STRING", "substring_index(if(instr(s, '(') > 1, substring_index(s, '(', 1), s), '.', -1)"),
    "containing_type": ("s STRING", "STRING", r"regexp_extract(if(instr(s, '(') > 1, substring_index(s, '(', 1), s), '(?s)^(.*)[.][^.]*$', 1)"),
    "normalize_route": ("s STRING", "STRING", "regexp_replace(trim(coalesce(s, '')), '^/+', '')"),
    "content_hash": ("s STRING", "STRING", "upper(sha2(s, 256))"),
    "decay_days": ("scope STRING, topic STRING", "INT", "CASE WHEN lower(trim(scope)) = 'session' THEN 1 WHEN topic = 'preference' THEN 365 WHEN topic IN ('pattern', 'decision') THEN 180 WHEN topic = 'bug' THEN 90 WHEN topic = 'todo' THEN 30 ELSE 60 END"),
    "normalize_generics": ("s STRING", "STRING", "regexp_replace(" + "regexp_replace(" * 8 + "s" + r", '<[^<>]*>', '\u0001')" * 8 + r", '\u0001', '<T>')"),
    "infer_kind": (
        "s STRING", "STRING",
        "CASE WHEN startswith(s, 'DI:') THEN 'di_registration' WHEN startswith(s, 'API:') THEN 'api_endpoint' WHEN startswith(s, 'config:') OR startswith(s, 'env:') THEN 'config_key' "
        "WHEN startswith(s, 'doc:') THEN if(instr(s, '#') > 0, 'section', 'document') WHEN instr(s, '(') > 0 THEN 'method' WHEN s RLIKE '[.]I\\\\p{Lu}[^.]*$' THEN 'interface' WHEN s IS NOT NULL THEN 'class' END",
    ),
    "sanitize_label": ("s STRING", "STRING", r"coalesce(nullif(regexp_replace(coalesce(s, ''), '[^\\p{L}\\p{Nd}_]', ''), ''), 'Unknown')"),
    "join_route": ("p STRING, r STRING", "STRING", "concat_ws('/', nullif(rtrim('/', coalesce(p, '')), ''), nullif(ltrim('/', coalesce(r, '')), ''))"),
    "expand_route": (
        "t STRING, controller STRING, action STRING", "STRING",
        r"regexp_replace(regexp_replace(t, '(?i)\\[controller\\]', regexp_replace(regexp_replace(controller, 'Controller$', ''), '([\\\\$])', '\\\\$1')), '(?i)\\[action\\]', regexp_replace(action, '([\\\\$])', '\\\\$1'))",
    ),
    "normalize_path": (
        "s STRING", "STRING",
        r"array_join(aggregate(split(translate(s, '\\', '/'), '/'), CAST(array() AS ARRAY<STRING>), (acc, p) -> CASE WHEN p IN ('', '.') THEN acc WHEN p = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) ELSE concat(acc, array(p)) END), '/')",
    ),
    "directory_of": ("s STRING", "STRING", r"regexp_extract(translate(s, '\\', '/'), '(?s)^(.*)/[^/]*$', 1)"),
    "module_of": ("s STRING", "STRING", "substring_index(s, ':', 1)"),
    "member_of": ("s STRING", "STRING", "if(instr(s, ':') > 0, regexp_replace(s, '^[^:]*:', ''), if(s IS NULL, NULL, ''))"),
    "slug": ("s STRING", "STRING", "regexp_replace(replace(replace(replace(lower(s), ' ', '-'), '---', '-'), '--', '-'), '^-+|-+$', '')"),
    "unquote": ("s STRING", "STRING", "regexp_replace(s, '(?s)^\"(.*)\"$', '$1')"),
    "cosine_similarity": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "if(size(a) = size(b), aggregate(zip_with(a, b, (p, q) -> p * q), 0D, (s, v) -> s + v) / nullif(sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)), 0D), NULL)",
    ),
    "decay_score": ("importance DOUBLE, age_seconds DOUBLE, days INT", "DOUBLE", "importance * exp(-pow(greatest(0D, age_seconds) / (86400D * days), 1.5D))"),
}
# fmt: on


class _Extract:
    def eval(self, path: str, content: str) -> Iterator[tuple]:
        from tessera.sources.extract import parse

        got = parse(path, content) if path and content else None
        for s in got.symbols if got else ():
            yield s.fqn, s.name, s.kind, s.signature, s.start, s.end


def register(spark: SparkSession) -> None:
    """Make the functions, and ``extract_symbols(path, content)`` as a table function for LATERAL, known to a session."""
    for name, (params, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    spark.udtf.register("extract_symbols", udtf(_Extract, returnType="fqn string, name string, kind string, signature string, start_line int, end_line int"))
