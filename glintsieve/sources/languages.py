"""Languages by file name, file classes, and directories that are not entered, as expressions over a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: extension -> language (fixed values)
EXTENSIONS = {
    **dict.fromkeys(["c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx"], "c"),
    "cs": "csharp",
    "go": "go",
    **dict.fromkeys(["java", "kt", "kts"], "jvm"),
    **dict.fromkeys(["js", "jsx", "mjs", "cjs", "ts", "tsx", "vue", "svelte", "astro"], "javascript"),
    **dict.fromkeys(["php", "phtml"], "php"),
    **dict.fromkeys(["py", "pyw"], "python"),
    **dict.fromkeys(["rb", "rake"], "ruby"),
    "rs": "rust",
    "swift": "swift",
    **dict.fromkeys(["json", "yaml", "yml", "toml", "tf", "tfvars", "ini", "conf", "sh", "bash"], "config"),
}
#: Directories that are never entered (fixed values).
IGNORED_DIRECTORIES = [
    ".git", ".hg", ".svn", ".next", ".nuxt", ".tox", ".venv", "build", "coverage", "dist", "node_modules", "target", "vendor", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".turbo", ".svelte-kit", ".astro", ".output", ".vercel", ".netlify", ".parcel-cache", ".yarn", ".pnpm-store", "bower_components", "Pods", ".gradle", "obj", ".terraform", "_build", ".serverless",
    ".expo", ".dart_tool", "site-packages", "htmlcov", ".nyc_output", "storybook-static",
]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """The language of a file name, null for unsupported ones."""
    name = base_name(path)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when((name == ".env") | name.startswith(".env.") | (name == "Dockerfile"), "config").otherwise(F.try_element_at(known, extension))


def in_ignored_directory(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*[F.lit(x) for x in IGNORED_DIRECTORIES]))


def file_class(path: Column) -> Column:
    """vendored, generated, example, test or production; the first that holds."""
    low = F.lower(path)
    parts = F.split(low, "/")
    among = lambda *names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    last = F.element_at(parts, -1)
    return (
        F.when(among("vendor", "node_modules", "third_party", "deps"), "vendored")
        .when(low.contains(".min.") | low.contains(".generated.") | among("generated"), "generated")
        .when(among("examples", "example", "samples"), "example")
        .when(among("test", "tests", "spec", "__tests__", "fixtures") | low.endswith("_test.go") | low.contains(".test.") | low.contains(".spec.") | last.startswith("test_") | (last == "conftest.py"), "test")
        .otherwise("production")
    )
