"""Column functions on file paths: language, category, folder kind, support."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension and language of files that are split as code.
CODE_LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "jsx": "jsx", "java": "java", "cpp": "cpp", "cc": "cpp", "c": "c", "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala"}
#: Extension and language of files that a profile counts.
PROFILE_LANGUAGES = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "jsx": "JavaScript", "tsx": "TypeScript", "java": "Java", "go": "Go", "rs": "Rust", "cpp": "C++", "c": "C", "cs": "C#", "rb": "Ruby", "php": "PHP",
    "swift": "Swift", "kt": "Kotlin", "scala": "Scala", "sh": "Shell", "yaml": "YAML", "yml": "YAML", "json": "JSON", "toml": "TOML", "xml": "XML", "html": "HTML", "css": "CSS", "scss": "SCSS", "md": "Markdown",
}
#: Extensions and names by which files are put into categories.
DOC_EXTENSIONS = ["md", "rst", "txt"]
SOURCE_EXTENSIONS = ["py", "js", "ts", "jsx", "tsx", "java", "go", "rs", "cpp", "c", "cs", "rb", "php", "swift", "kt", "scala"]
CONFIG_EXTENSIONS = ["yaml", "yml", "toml", "ini", "cfg", "json"]
SCRIPT_EXTENSIONS = ["sh", "bash", "zsh", "ps1", "bat", "cmd"]
ASSET_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "svg", "ico", "webp"]
CONFIG_NAMES = [
    ".env.example", ".env", "docker-compose.yml", "Dockerfile", "pyproject.toml", "setup.cfg", "tox.ini", "pytest.ini", "mypy.ini",
    ".prettierrc", ".eslintrc", "tsconfig.json", ".eslintrc.js", ".eslintrc.json", "jest.config.js", "babel.config.js",
    "webpack.config.js", "vite.config.ts", "nginx.conf", "supervisord.conf",
]
IMPORTANT_NAMES = [
    "README.md", "README.rst", "LICENSE", "Dockerfile", "docker-compose.yml", "requirements.txt", "package.json", "pyproject.toml",
    "setup.py", "pom.xml", "build.gradle", "Makefile", ".env.example", ".gitignore",
]
ENTRY_NAMES = [
    "main.py", "app.py", "server.py", "manage.py", "run.py", "wsgi.py", "asgi.py", "index.js", "server.js", "app.js", "main.ts",
    "server.ts", "App.tsx", "index.ts",
]
#: Folder names and the kind they stand for.
FOLDER_KINDS = {
    "API": ["api", "routes", "controllers", "endpoints", "handlers"],
    "Authentication": ["auth", "authentication", "jwt", "oauth"],
    "Database": ["database", "db", "models", "schemas", "repositories", "migrations"],
    "Services": ["services", "usecases", "business"],
    "RAG / AI": ["rag", "embeddings", "llm", "agents", "prompts", "retrieval"],
    "Utilities": ["utils", "helpers", "common", "core", "lib"],
    "Infrastructure": ["infra", "infrastructure", "docker", "k8s", "config"],
    "Testing": ["tests", "test", "spec", "e2e"],
    "Application Layer": ["app", "src"],
    "UI Components": ["components", "views", "pages", "hooks", "widgets"],
}
#: Folders a scan does not enter, extensions it does not read.
IGNORED_FOLDERS = [
    ".git", ".idea", ".vscode", "__pycache__", "node_modules", "venv", ".venv", "env", "dist", "build", "coverage", ".pytest_cache",
    ".mypy_cache",
]
IGNORED_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "tar", "gz", "7z", "exe", "dll", "so", "obj", "o", "class", "pyc"]
#: Fixed values: (file, word in its first 4096 characters, framework).
FRAMEWORK_RULES = [
    ("requirements.txt", "fastapi", "FastAPI"), ("requirements.txt", "django", "Django"), ("requirements.txt", "flask", "Flask"), ("requirements.txt", "tornado", "Tornado"), ("requirements.txt", "starlette", "Starlette"),
    ("pyproject.toml", "fastapi", "FastAPI"), ("pyproject.toml", "django", "Django"), ("pyproject.toml", "flask", "Flask"),
    ("package.json", '"next"', "Next.js"), ("package.json", '"react"', "React"), ("package.json", '"vue"', "Vue.js"), ("package.json", '"angular"', "Angular"), ("package.json", '"express"', "Express"), ("package.json", '"svelte"', "Svelte"), ("package.json", '"nuxt"', "Nuxt.js"),
    ("pom.xml", "spring-boot", "Spring Boot"), ("build.gradle", "spring-boot", "Spring Boot"),
]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def folder(path: Column) -> Column:
    """The path without its last part; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower case and without the dot; empty for none, and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(path), "^.+\\.([^.]*)$", 1))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def language(path: Column) -> Column:
    """The language a file is split as: of its code extension, "documentation" for prose, else "unknown"."""
    ext = extension(path)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CODE_LANGUAGES.items() for x in kv)), ext), F.when(ext.isin(DOC_EXTENSIONS), F.lit("documentation")), F.lit("unknown"))


def profile_language(path: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in PROFILE_LANGUAGES.items() for x in kv)), extension(path))


def is_supported(path: Column) -> Column:
    return ~extension(path).isin(IGNORED_EXTENSIONS) & (language(path) != "unknown") & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_FOLDERS)))


def category(path: Column) -> Column:
    """Tests go before everything, so test_x.md is a test."""
    name, ext = base_name(path), extension(path)
    return (
        F.when(F.lower(name).rlike("test_|_test\\.|\\.test\\.|\\.spec\\."), "Test")
        .when(ext.isin(SOURCE_EXTENSIONS), "Source Code")
        .when(ext.isin(DOC_EXTENSIONS), "Documentation")
        .when(name.isin(CONFIG_NAMES) | ext.isin(CONFIG_EXTENSIONS), "Configuration")
        .when(ext.isin(SCRIPT_EXTENSIONS), "Script")
        .when(ext.isin(ASSET_EXTENSIONS), "Asset")
        .otherwise("Unknown")
    )


def folder_kind(path: Column) -> Column:
    """Of a folder's path, by its last part; the root is "Project Root"."""
    last = F.lower(base_name(path))
    out = F.when(path == "", "Project Root")
    for kind, names in FOLDER_KINDS.items():
        out = out.when(last.isin(names), kind)
    return out.otherwise("Feature Module")
