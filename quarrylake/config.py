"""Constants that define semantics, in one place."""

# Search
OVERFETCH, DEFAULT_LIMIT = 3, 10
# Line chunks
CHUNK_TARGET, CHUNK_MAX, CHUNK_OVERLAP = 50, 100, 5
MAX_FILE_BYTES = 1_048_576
# Graph learning
PROVISIONAL, REINFORCE, WEAKEN, PARTIAL, CONFIRM_AFTER = 0.3, 0.2, 0.15, 0.05, 2
HALF_LIFE_DAYS, GC_FLOOR, ORPHAN_DAYS = 30.0, 0.05, 7
MAX_EDITS, SUBSTRING_FLOOR = 2, 0.5
# Notes
DUPLICATE, PREVIEW = 0.85, 200
RECENCY_WEIGHT, SEVERITY_WEIGHT, STALE_DAYS = 0.3, 0.7, 30
RUN_SIMILARITY, RUN_LENGTH = 0.80, 3
TOKENS_PER_BYTE = 0.25

# Extension -> language, excluded folders, trigger phrases.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript",
    "go": "go", "java": "java", "c": "c", "cpp": "cpp", "cc": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp",
    "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "shell", "bash": "shell",
    "zsh": "shell", "sql": "sql", "md": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml",
    "xml": "xml", "html": "html", "css": "css", "scss": "scss", "vue": "vue", "svelte": "svelte",
}
EXCLUDED_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "target", "build", "dist", ".next", ".nuxt", "vendor",
    ".cargo", ".rustup", "Pods", ".gradle", ".idea", ".vs", ".vscode", "coverage", ".pytest_cache", ".mypy_cache",
    ".tox", "eggs", ".sass-cache", "bower_components", ".terraform", "obj", "bin", "site-packages",
)
IGNORE_FILES = (".gitignore", ".ignore")
SHOWN_HIDDEN = (".github", ".gitignore")
IGNORED_FILES = (".ds_store", "thumbs.db", ".env", ".env.local")
IGNORED_ENDS = (".lock", "-lock.json", ".min.js", ".min.css")
EXCLUDED_PREFIXES = ("Raw_Evidence", "RawEvidence", "Evidence_", "Evidence ")
CORRECTIONS = (
    "no,", "no.", "no!", "no ", "don't", "dont", "stop", "wrong", "that's not", "thats not", "that is not",
    "incorrect", "not what i", "shouldn't", "should not",
)
SAVES = (
    "remember", "save this", "lesson learned", "note to self", "keep in mind", "don't forget", "important:",
    "remember this", "take note",
)
BUILD_FAILURES = (
    "error[E", "FAILED", "panic", "cannot find", "unresolved import", "mismatched types", "aborting due to",
    "could not compile",
)
# Tags of notes -> globs of the files that they are about. Users add their own.
TAG_GLOBS = (
    (("sqlite", "rusqlite", "database", "db"), ("src/storage/**/*.rs", "**/*sqlite*")),
    (("axum", "http", "server", "api", "rest", "mcp"), ("src/server/**/*.rs",)),
    (("embedding", "embeddings", "onnx", "ort"), ("src/embeddings/**/*.rs",)),
    (("watcher", "notify", "indexer", "file-watch"), ("src/watcher/**/*.rs",)),
    (("graph", "petgraph", "knowledge-graph"), ("src/graph/**/*.rs",)),
    (("cargo", "rust", "rustc", "clippy"), ("*.rs", "Cargo.toml")),
    (("git", "gitignore"), (".gitignore", "**/*.rs")),
    (("config", "configuration", "settings"), ("src/config/**/*.rs", "**/*.toml", "**/*.json")),
    (("test", "testing"), ("tests/**/*.rs", "src/**/*test*")),
    (("cli", "clap", "command"), ("src/main.rs", "src/cli/**/*.rs")),
    (("docker", "container"), ("Dockerfile", "docker-compose*.yml")),
    (("ci", "github-actions", "pipeline"), (".github/**/*.yml",)),
    (("serde", "json", "serialization"), ("**/*.json", "**/*.rs")),
    (("toml", "yaml", "yml"), ("**/*.toml", "**/*.yml", "**/*.yaml")),
    (("error", "error-handling", "thiserror", "anyhow"), ("src/error/**/*.rs", "**/*.rs")),
    (("async", "tokio", "futures"), ("**/*.rs",)),
)
# Types of graph nodes, kinds of edges.
ENTITY_TYPES = (
    "agent", "tool", "problem", "solution", "concept", "person", "project", "chunk", "struct_function", "struct_class",
    "struct_method", "struct_module", "struct_import",
)
RELATIONSHIPS = (
    "used", "solved", "failed_for", "knows", "prefers", "depends_on", "related_to", "derived_from", "encountered",
    "solved_by", "calls", "imported_by", "inherits", "tests", "contains",
)
# Limits of texts
INJECT_CHARS, INJECT_LEAST, INDEX_LINES, RATE_SECONDS, SETTLED_SECONDS = 2000, 50, 200, 300, 60
CONCEPTS_OF_CHECKPOINT, EDGE_FEED = 5, 10_000
