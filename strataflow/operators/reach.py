"""Static reachability inputs: imports, entry points, tokens (RCH-01 to RCH-03, EXP-21)."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Packages that a module or a token loads without importing them by name.
IMPLIED_BY_MODULE = {
    "django.db.backends.postgresql": ("psycopg", "psycopg2", "psycopg2-binary", "psycopg-binary", "psycopg-c"),
    "django": ("tzdata", "sqlparse", "asgiref"),
    "zoneinfo": ("tzdata",),
    "redis": ("hiredis",),
    "requests": ("urllib3", "idna", "certifi", "charset-normalizer"),
    "paramiko": ("ecdsa", "pycrypto", "pycryptodome", "cryptography", "bcrypt", "pynacl", "pyasn1"),
    "ncclient": ("lxml", "paramiko", "six"),
    "readme_renderer": ("bleach", "docutils", "pygments"),
    "alembic": ("mako", "sqlalchemy"),
    "rsa": ("pyasn1",),
}
IMPLIED_BY_TOKEN = {"ImageField": ("pillow",)}
ENTRYPOINT_FILES = ("Dockerfile", "Procfile", "*.sh", "*.ini", "*.cfg", "*.toml", "*.yml", "*.yaml", "*.conf", "gunicorn*.py", "uwsgi*")
# Import names that differ from the distribution's.
KNOWN_IMPORTS = {
    "pyyaml": ("yaml",), "pillow": ("PIL",), "beautifulsoup4": ("bs4",), "python-dateutil": ("dateutil",), "pyjwt": ("jwt",), "psycopg2-binary": ("psycopg2",),
    "psycopg-binary": ("psycopg",), "psycopg-c": ("psycopg",), "psycopg-pool": ("psycopg_pool",), "pycryptodome": ("Crypto",), "pycrypto": ("Crypto",),
    "pycryptodomex": ("Cryptodome",), "scikit-learn": ("sklearn",), "opencv-python": ("cv2",), "protobuf": ("google.protobuf", "google"),
    "google-cloud-storage": ("google.cloud.storage",), "google-auth": ("google.auth",), "google-api-core": ("google.api_core",),
    "googleapis-common-protos": ("google.api", "google.rpc"), "grpcio": ("grpc",), "msgpack-python": ("msgpack",), "python-slugify": ("slugify",),
    "django-filter": ("django_filters",), "djangorestframework": ("rest_framework",), "django-cors-headers": ("corsheaders",), "django-redis": ("django_redis",),
    "django-rq": ("django_rq",), "social-auth-app-django": ("social_django",), "social-auth-core": ("social_core",), "django-debug-toolbar": ("debug_toolbar",),
    "django-graphiql-debug-toolbar": ("graphiql_debug_toolbar",), "django-mptt": ("mptt",), "django-taggit": ("taggit",), "django-tables2": ("django_tables2",),
    "django-timezone-field": ("timezone_field",), "drf-spectacular": ("drf_spectacular",), "drf-spectacular-sidecar": ("drf_spectacular_sidecar",),
    "strawberry-graphql": ("strawberry",), "strawberry-graphql-django": ("strawberry_django",), "mkdocs-material": ("material",), "markdown": ("markdown",),
    "pyotp": ("pyotp",), "fido2": ("fido2",), "whitenoise": ("whitenoise",), "django-compressor": ("compressor",), "django-stubs-ext": ("django_stubs_ext",),
    "typing-extensions": ("typing_extensions",), "attrs": ("attr", "attrs"), "setuptools": ("setuptools", "pkg_resources"), "python-json-logger": ("pythonjsonlogger",),
    "pynacl": ("nacl",), "pyopenssl": ("OpenSSL",), "python-multipart": ("multipart",), "zope-interface": ("zope.interface", "zope"), "zope-sqlalchemy": ("zope.sqlalchemy",),
    "zope-deprecation": ("zope.deprecation",), "pyramid-jinja2": ("pyramid_jinja2",), "sqlalchemy-utils": ("sqlalchemy_utils",), "email-validator": ("email_validator",),
    "python-magic": ("magic",), "readme-renderer": ("readme_renderer",), "webauthn": ("webauthn",), "b2sdk": ("b2sdk",), "pymacaroons": ("pymacaroons",),
    "sentry-sdk": ("sentry_sdk",), "opensearch-py": ("opensearchpy",), "elasticsearch-dsl": ("elasticsearch_dsl",), "pip-api": ("pip_api",), "rfc3986": ("rfc3986",),
    "pyparsing": ("pyparsing",), "importlib-metadata": ("importlib_metadata",), "importlib-resources": ("importlib_resources",),
    "charset-normalizer": ("charset_normalizer",), "ua-parser": ("ua_parser",), "user-agents": ("user_agents",), "argon2-cffi": ("argon2",),
    "argon2-cffi-bindings": ("_argon2_cffi_bindings",), "cffi": ("cffi", "_cffi_backend"), "markupsafe": ("markupsafe",), "jinja2": ("jinja2",), "werkzeug": ("werkzeug",),
    "flask-babel": ("flask_babel",), "flask-sqlalchemy": ("flask_sqlalchemy",), "flask-wtf": ("flask_wtf",), "flask-assets": ("flask_assets",), "wtforms": ("wtforms",),
    "celery-redbeat": ("redbeat",), "hiredis": ("hiredis",), "pretty-bad-protocol": ("pretty_bad_protocol",), "python-gnupg": ("gnupg",), "redis": ("redis",), "rq": ("rq",),
    "mod-wsgi": ("mod_wsgi",),
}
_PREFIXES = ("python-", "py-", "django-", "flask-", "pyramid-")
_DOTTED = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)+", re.A)
_WORD = re.compile(r"[A-Za-z_]\w{2,}", re.A)
#: Functions whose first argument names a module.
LOADERS = ("import_module", "__import__", "include")


def import_names(dist):
    """Import names of a normalised distribution name: the known ones, else guesses in order."""
    known = F.create_map(*[c for name, modules in KNOWN_IMPORTS.items() for c in (F.lit(name), F.array(*map(F.lit, modules)))])
    under = lambda c: F.replace(c, F.lit("-"), F.lit("_"))
    none = F.lit(None).cast("string")
    cut = [F.when(dist.startswith(p) & (F.length(dist) > len(p) + 2), under(F.substring(dist, F.lit(len(p) + 1), F.length(dist)))).otherwise(none) for p in _PREFIXES]
    binary = F.when(dist.endswith("-binary"), under(F.substring(dist, F.lit(1), F.length(dist) - 7))).otherwise(none)
    parts = F.split(dist, "-")
    n = F.size(parts)
    rest = lambda k: F.array_join(F.slice(parts, F.lit(k + 1), F.greatest(n - k, F.lit(1))), "_")
    spaces = [F.when(n > 1, F.replace(dist, F.lit("-"), F.lit("."))), F.when(n > 1, F.concat(F.get(parts, F.lit(0)), F.lit("."), rest(1))), F.when(n > 2, F.concat(F.get(parts, F.lit(0)), F.lit("."), F.get(parts, F.lit(1)), F.lit("."), rest(2)))]
    return F.coalesce(F.try_element_at(known, dist), F.array_compact(F.array(under(dist), *cut, binary, *spaces)))


def _plain(node):
    return [("module", a.name) for a in node.names]


def _from(node):
    names = ["", *(f".{a.name}" for a in node.names if a.name != "*")]
    return [] if node.level else [("module", node.module + n) for n in names]


def _text(node):
    kinds = (("module", _DOTTED, str), ("word", _WORD, str.lower))
    return [(kind, form(node.value)) for kind, shape, form in kinds if isinstance(node.value, str) and shape.fullmatch(node.value)]


def _loader(node):
    called = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
    target = node.args[0].value if node.args and isinstance(node.args[0], ast.Constant) else None
    return [("module", target)] if called in LOADERS and isinstance(target, str) else []


_READERS = {ast.Import: _plain, ast.ImportFrom: _from, ast.Constant: _text, ast.Call: _loader}


def mentions_of(text: str | None) -> list[tuple[str, str]]:
    """(module, dotted name) with all prefixes and (word, lower-case string) of a Python text; none of a broken text."""
    try:
        nodes = ast.walk(ast.parse(text or ""))
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = {m for n in nodes if type(n) in _READERS for m in _READERS[type(n)](n)}
    prefixes = {("module", x[: dot.start()]) for kind, x in found if kind == "module" for dot in re.finditer(r"\.", x)}
    return sorted(found | prefixes)


def _mentions(batches):
    for batch in batches:
        rows = [(p, *m) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) for m in mentions_of(t)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (list(zip(*rows)) if rows else [[]] * 3)], ["path", "kind", "name"])


def mentions(files: DataFrame) -> DataFrame:
    """path, kind (module or word), name of Python files (path, text); null and broken texts have none."""
    return files.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(_mentions, "path string, kind string, name string")


def app_imports(files: DataFrame) -> DataFrame:
    """path, module of Python files (path, text), with all dotted prefixes."""
    return mentions(files).filter("kind = 'module'").select("path", F.col("name").alias("module"))


def referenced(found: DataFrame, names: DataFrame) -> DataFrame:
    """dist of names (dist, import_name) whose undotted import name is a word of the mentions, in any case: the weakest tier."""
    words = found.filter("kind = 'word'").select(F.col("name").alias("word")).distinct()
    return names.filter(~F.contains("import_name", F.lit("."))).select("dist", F.lower("import_name").alias("word")).join(words, "word", "left_semi").select("dist").distinct()


def entrypoint_hits(files: DataFrame, names: DataFrame) -> DataFrame:
    """dist of names (dist, import_name) that configuration files under 2 MB mention; files stay rows."""
    match = F.lit(False)
    base = F.substring_index("path", "/", -1)
    for g in ENTRYPOINT_FILES:
        match = match | base.rlike("^" + g.replace(".", r"\.").replace("*", ".*") + "$")
    words = files.filter(match & (F.octet_length("text") < 2_000_000)).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z_][a-z0-9_.-]*)"), F.lit(1)))).alias("word")).distinct()
    return names.select("dist", F.lower("import_name").alias("word")).join(words, "word", "left_semi").select("dist").distinct()


def implied(modules: DataFrame, files: DataFrame) -> DataFrame:
    """dist that imported modules or source tokens load."""
    spark = modules.sparkSession
    by_module = spark.createDataFrame([(m, d) for m, ds in IMPLIED_BY_MODULE.items() for d in ds], "module string, dist string")
    out = by_module.join(modules.select("module"), "module", "left_semi").select("dist")
    for token, dists in IMPLIED_BY_TOKEN.items():
        hit = files.filter(F.contains("text", F.lit(token))).limit(1)
        out = out.union(hit.select(F.explode(F.array(*map(F.lit, dists))).alias("dist")))
    return out.distinct()
