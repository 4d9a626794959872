"""Names, suffixes and markers that results must agree on, in plain order."""

#: Suffix to language, for a slice of a file.
CHUNK_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript",
    ".rs": "rust", ".go": "go", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".rb": "ruby",
    ".php": "php", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
    ".toml": "toml", ".md": "markdown", ".html": "html", ".css": "css", ".sql": "sql",
}

#: Suffix to language, for parsing.
PARSED_LANGUAGES = {
    ".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go",
}

#: Directories that a scan leaves out.
IGNORED_DIRECTORIES = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".egg-info", ".pytest_cache",
    ".mypy_cache", ".tox", ".coverage", "htmlcov", ".cache", ".next", "out", "target",
)

#: Of these, what a tree that is read without a scan leaves out.
READ_IGNORED = IGNORED_DIRECTORIES[:10]

#: Files that are never read: by suffix, by name, by size in bytes.
SKIPPED_SUFFIXES = (
    ".min.js", ".lock", ".bin", ".exe", ".map", ".png", ".jpg", ".jpeg", ".gif", ".woff", ".woff2", ".ttf", ".ico",
    ".pdf", ".zip", ".tar", ".gz", ".pyc",
)
SKIPPED_NAMES = ("package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock", "composer.lock")
MOST_BYTES = 500 * 1024

#: Marker files of a subproject, first match first: name, language, test command.
SUBPROJECT_MARKERS = (
    ("pyproject.toml", "python", "pytest"),
    ("setup.py", "python", "pytest"),
    ("package.json", "javascript", "npm test"),
    ("tsconfig.json", "typescript", "npm test"),
    ("go.mod", "go", "go test ./..."),
)
SUBPROJECT_IGNORED = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build")

#: Functions that are called without a visible call: special methods, entry points, decorators.
SPECIAL_METHODS = (
    "__init__", "__new__", "__del__", "__str__", "__repr__", "__eq__", "__hash__", "__lt__", "__le__", "__gt__",
    "__ge__", "__bool__", "__len__", "__getitem__", "__setitem__", "__delitem__", "__iter__", "__next__", "__enter__",
    "__exit__", "__call__", "__getattr__", "__setattr__", "__delattr__", "__contains__", "__add__", "__sub__",
    "__mul__", "__truediv__", "__floordiv__", "__mod__", "__pow__", "__and__", "__or__", "__xor__", "__neg__",
    "__pos__", "__abs__", "__invert__", "__int__", "__float__", "__complex__", "__bytes__", "__copy__",
    "__deepcopy__", "__reduce__", "__reduce_ex__", "__getstate__", "__setstate__", "__dir__", "__sizeof__",
    "__weakref__", "__format__", "__subclasshook__", "__init_subclass__", "__class_getitem__",
)
ENTRY_POINT_FUNCTIONS = ("main", "run", "start", "execute", "entry_point", "cli", "app", "create_app")
FRAMEWORK_DECORATORS = (
    "app.route", "route", "api.route", "router.get", "router.post", "router.put", "router.delete", "router.patch",
    "pytest.fixture", "fixture", "property", "staticmethod", "classmethod", "validator", "root_validator",
    "column_property", "association_proxy", "click.command", "click.group", "click.option", "click.argument",
)

#: Architecture classes in tie order, with the markers that their stems hold.
ARCHITECTURES = (
    ("CLI tool", ("main", "__main__", "cli", "argparse", "click", "typer", "fire")),
    ("REST API", ("route", "router", "app", "fastapi", "flask", "django", "starlette", "endpoint", "handler")),
    ("library", ("setup", "pyproject", "package", "module", "__init__")),
    ("web frontend", ("component", "render", "jsx", "tsx", "react", "vue", "svelte", "page", "layout")),
)
ENTRY_POINT_STEMS = ("main", "__main__", "app", "server", "index", "cli", "run", "manage")
MODULES_SKIPPED = (
    "test", "tests", "spec", "conftest", "setup", "pyproject", "__init__", "utils", "helpers", "constants", "config",
)

#: Ways in which an import path may name a file, first match first.
IMPORT_SUFFIXES = ("", ".py", ".js", ".ts", ".tsx", ".jsx")

#: Parts of a command line that chain commands.
CHAINING = (";", "&&", "||", "|", "`", "$(")

#: Keys of an empty state.
STATE_KEYS = ("created_at", "last_scan", "architecture_hypothesis", "health_history", "fix_log", "embeddings_cache", "pending_fixes")
