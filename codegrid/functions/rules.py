"""Language rule table (U1): extension map and extraction patterns.

Adding a language = one entry in ``EXTENSIONS`` plus one entry in
``LANG_RULES``; every extraction job reads these two tables.

The patterns are written in Python ``re`` syntax; ``java_re`` turns one into
the equivalent Java pattern for the JVM-side ``regexp_extract_all`` (Unicode
``\\w`` like Python, only ``\\n`` ends a line like Python).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the documented behaviour for equal results)
# ---------------------------------------------------------------------------

# language -> file suffixes, in configuration order (first language wins)
EXTENSIONS: dict[str, list[str]] = {
    "java": [".java"],
    "csharp": [".cs", ".cshtml"],
    "vbnet": [".vb", ".vbhtml"],
    "fsharp": [".fs", ".fsx"],
    "php": [".php"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx"],
    "markup": [".html", ".htm"],
    "config": [".json", ".yaml", ".yml"],
}

# default exclude globs of the documentation settings
DEFAULT_EXCLUDES: list[str] = [
    "**/node_modules/**", "**/vendor/**", "**/bin/**", "**/obj/**",
    "**/.git/**", "**/target/**", "**/build/**", "**/dist/**",
    "**/packages/**", "**/*.min.js", "**/*.bundle.js", "**/*.dll",
    "**/*.so", "**/*.jar", "**/*.exe",
]

DEFAULT_MAX_FILE_MB = 10

# Header-level patterns per language. Each "types" entry is
# (kind, pattern, name_group, extends_group, implements_group); a group index
# of 0 means "not captured". Both parent groups are comma lists (a single
# name splits to itself). The extends group is called "inherits" for the
# kinds listed in INHERITS_KINDS.
LANG_RULES: dict[str, dict] = {
    "java": {
        "namespace": r"package\s+([\w.]+);",
        "imports": [r"import\s+(?:static\s+)?([\w.*]+);"],
        "types": [
            ("class", r"(?:public|private|protected|abstract|final|static)?\s*class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?\s*\{", 1, 2, 3),
            ("interface", r"(?:public|private|protected)?\s*interface\s+(\w+)(?:\s+extends\s+([\w,\s]+))?\s*\{", 1, 2, 0),
            ("enum", r"(?:public|private|protected)?\s*enum\s+(\w+)\s*\{", 1, 0, 0),
        ],
        "modifiers": ["public", "private", "protected", "static", "final", "abstract", "synchronized"],
        "comments": "c",
    },
    "csharp": {
        "namespace": r"namespace\s+([\w.]+)",
        "imports": [r"using\s+(?:static\s+)?([\w.*=]+);"],
        "types": [
            ("class", r"(?:public|private|internal|protected|abstract|sealed|static|partial)?\s*class\s+(\w+)(?:\s*:\s*([\w,\s<>]+))?\s*\{", 1, 2, 0),
            ("interface", r"(?:public|private|internal|protected)?\s*interface\s+(\w+)(?:\s*:\s*([\w,\s]+))?\s*\{", 1, 2, 0),
            ("enum", r"(?:public|private|internal)?\s*enum\s+(\w+)\s*\{", 1, 0, 0),
            ("struct", r"(?:public|private|internal)?\s*struct\s+(\w+)(?:\s*:\s*([\w,\s]+))?\s*\{", 1, 2, 0),
        ],
        "modifiers": ["public", "private", "internal", "protected", "static", "virtual", "override",
                      "abstract", "sealed", "partial", "async", "readonly", "const"],
        "comments": "c",
    },
    "vbnet": {
        "namespace": r"(?i)Namespace\s+([\w.]+)",
        "imports": [r"(?i)Imports\s+([\w.*=]+)"],
        "types": [
            ("class", r"(?i)(?:Public|Private|Friend|Protected|MustInherit|NotInheritable|Partial)?\s*Class\s+(\w+)(?:\s+Inherits\s+([\w,\s<>]+))?\s*", 1, 2, 0),
            ("interface", r"(?i)(?:Public|Private|Friend)?\s*Interface\s+(\w+)(?:\s+Inherits\s+([\w,\s]+))?\s*", 1, 2, 0),
            ("enum", r"(?i)(?:Public|Private|Friend)?\s*Enum\s+(\w+)\s*", 1, 0, 0),
            ("structure", r"(?i)(?:Public|Private|Friend)?\s*Structure\s+(\w+)(?:\s+Implements\s+([\w,\s]+))?\s*", 1, 0, 2),
            ("module", r"(?i)(?:Public|Private|Friend)?\s*Module\s+(\w+)\s*", 1, 0, 0),
        ],
        # the configured list names MustInherit twice; reported once here
        "modifiers": ["Public", "Private", "Friend", "Protected", "Shared", "Overridable", "Overrides",
                      "MustOverride", "MustInherit", "NotInheritable", "Partial", "Async", "ReadOnly", "Const"],
        "comments": "vb",
    },
    "fsharp": {
        "namespace": r"(?i)namespace\s+([\w.]+)",
        "imports": [r"(?i)open\s+([\w.*=]+)"],
        "types": [
            ("module", r"(?i)(?:public\s+)?module\s+(\w+)\s*=", 1, 0, 0),
            ("class", r"(?i)(?:type\s+)?(\w+)\s*\([^)]*\)\s*=\s*class", 1, 0, 0),
            ("interface", r"(?i)type\s+(\w+)\s*=\s*interface", 1, 0, 0),
            ("record", r"(?i)type\s+(\w+)\s*=\s*\{[^}]*\}", 1, 0, 0),
        ],
        "modifiers": ["public", "private", "internal", "static", "abstract", "override", "rec"],
        "functions": [r"(?i)(?:let\s+(?:rec\s+)?|member\s+)?(\w+)\s*\([^)]*\)\s*(?::\s*[\w<>,\s\[\]]+)?\s*="],
        "function_skip": ["if", "for", "while", "match", "try", "with"],
        "comments": "fs",
    },
    "php": {
        "namespace": r"namespace\s+([\w\\]+);",
        "imports": [r"use\s+([\w\\]+)(?:\s+as\s+\w+)?;"],
        "types": [
            ("class", r"(?:abstract|final)?\s*class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?\s*\{", 1, 2, 3),
            ("interface", r"interface\s+(\w+)(?:\s+extends\s+([\w,\s]+))?\s*\{", 1, 2, 0),
            ("trait", r"trait\s+(\w+)\s*\{", 1, 0, 0),
        ],
        "modifiers": ["public", "private", "protected", "static", "final", "abstract"],
        "comments": "c",
    },
    "javascript": {
        "namespace": None,
        "imports": [r"import\s+(?:[\w*\s{},]+)\s+from\s+['\"]([^'\"]+)['\"]",
                    r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"],
        "types": [
            ("class", r"class\s+(\w+)(?:\s+extends\s+([\w.]+))?\s*\{", 1, 2, 0),
        ],
        "modifiers": [],
        "functions": [r"function\s+(\w+)\s*\([^)]*\)\s*\{",
                      r"(?:const|let|var)\s+(\w+)\s*=\s*\([^)]*\)\s*=>"],
        "function_skip": [],
        "comments": "c",
    },
    "typescript": {
        "namespace": None,
        "imports": [r"import\s+(?:[\w*\s{},]+)\s+from\s+['\"]([^'\"]+)['\"]",
                    r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"],
        "types": [
            ("class", r"(?:@\w+\([^)]*\)\s*)*(?:export\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?(?:\s+implements\s+([\w,\s.]+))?\s*\{", 1, 2, 3),
            ("interface", r"(?:export\s+)?interface\s+(\w+)(?:\s+extends\s+([\w,\s.]+))?\s*\{", 1, 2, 0),
            ("type", r"(?:export\s+)?type\s+(\w+)\s*=", 1, 0, 0),
            ("enum", r"(?:export\s+)?enum\s+(\w+)\s*\{", 1, 0, 0),
        ],
        "modifiers": [],
        "functions": [r"function\s+(\w+)\s*\([^)]*\)\s*(?::\s*[\w<>\[\]\|]+)?\s*\{",
                      r"(?:const|let|var)\s+(\w+)\s*=\s*\([^)]*\)\s*=>"],
        "function_skip": [],
        "comments": "c",
    },
    "markup": {"namespace": None, "imports": [], "types": [], "modifiers": [], "comments": "html"},
    "config": {"namespace": None, "imports": [], "types": [], "modifiers": [], "comments": "c"},
}

INHERITS_KINDS = {("csharp", "class"), ("csharp", "struct"), ("vbnet", "class"), ("vbnet", "interface")}

# comment styles: list of (pattern, style) scanned in this order
COMMENT_RULES: dict[str, list[str]] = {
    "c": [r"(?m)//.*?$", r"(?s)/\*.*?\*/"],
    "vb": [r"(?m)'.*?$", r"(?im)REM\s+.*?$"],
    "fs": [r"(?m)//.*?$", r"(?s)\(\*.*?\*\)"],
    "html": [r"(?s)<!--(.*?)-->"],
}

MARKUP_TAG = r"<\s*([a-zA-Z][\w-]*)"

# ---------------------------------------------------------------------------


def java_re(pattern: str) -> str:
    """Python ``re`` pattern -> Java pattern with Python's defaults.

    ``(?U)``: ``\\w``/``\\s``/``\\d`` are Unicode-aware as in Python 3;
    ``(?d)``: only ``\\n`` is a line terminator for ``.``, ``^`` and ``$``.
    Inline flags given at the start of ``pattern`` are merged in.
    """
    flags = "Ud"
    body = pattern
    if body.startswith("(?") and ")" in body and body[2] != ":" and body[2] not in "=!<>":
        close = body.index(")")
        inline = body[2:close]
        if inline.isalpha():
            flags += inline
            body = body[close + 1:]
    return f"(?{flags}){body}"
