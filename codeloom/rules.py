"""Rule tables. The values are fixed: results depend on each of them and on their order."""

from __future__ import annotations

# Language by extension; None leaves it to the content.
EXTENSIONS = {
    ".py": "Python", ".pyw": "Python", ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript",
    ".tsx": "TypeScript", ".jsx": "JavaScript", ".java": "Java", ".go": "Go", ".rs": "Rust", ".cpp": "C++", ".cxx": "C++",
    ".cc": "C++", ".c": "C", ".h": None, ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".kt": "Kotlin", ".swift": "Swift",
    ".scala": "Scala", ".r": "R", ".sh": "Bash", ".bash": "Bash", ".sql": "SQL",
}

# Extensions and size of repository files that are read, and markers of paths that aren't.
REPO_EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".cpp", ".c", ".rb", ".php", ".cs", ".kt", ".swift")
EXCLUDED_PATHS = ("node_modules", "vendor", "dist/", "build/", ".min.", "package-lock", "yarn.lock", "__pycache__")
MAX_FILE_KB = 500
MAX_REPO_FILES = 200
CHUNK_LINES = 300

# Language by content, in order: (language, expression, whether ^ holds at every line).
CONTENT = (
    ("Python", r"^\s*def\s+\w+\s*\(|import\s+\w+|from\s+\w+\s+import", True),
    ("JavaScript", r"^\s*function\s+\w+|const\s+\w+\s*=|let\s+\w+", True),
    ("Java", r"public\s+(class|interface|enum)\s+\w+", False),
    ("Go", r"^package\s+main|^func\s+\w+", True),
    ("Rust", r"^fn\s+\w+|let\s+mut\s+", True),
    ("C", r"#include\s*<", False),
)

# Era signatures by language, in order: (expression, era, hint).
ERAS = {
    "Python": (
        (r"\bprint\s+['\"]", "2.x", "print as statement"),
        (r"\bprint\s+\(", None, None),
        (r"\bxrange\s*\(", "2.x", "xrange() — removed in Python 3"),
        (r"\.has_key\s*\(", "2.x", "dict.has_key() — removed in Python 3"),
        (r"\bexcept\s+\w+\s*,\s*\w+", "2.x", "except E, e syntax — Python 2 style"),
        (r"\burllib2\b", "2.x", "urllib2 — replaced by urllib.request in Python 3"),
        (r"\braw_input\s*\(", "2.x", "raw_input() — renamed to input() in Python 3"),
        (r"^#.*coding[:=]\s*(utf-8|latin-1)", "2.x", "explicit encoding declaration — Python 2"),
        (r"\bbasestring\b", "2.x", "basestring — removed in Python 3"),
        (r"\bunicode\s*\(", "2.x", "unicode() builtin — removed in Python 3"),
        (r"async\s+def|await\s+", "3.5+", "async/await — Python 3.5+"),
        (r"f[\"'].*\{", "3.6+", "f-strings — Python 3.6+"),
        (r":=", "3.8+", "walrus operator — Python 3.8+"),
        (r"^match\s+\w+", "3.10+", "match/case — Python 3.10+"),
    ),
    "JavaScript": (
        (r"\bvar\s+\w+", "ES5", "var declarations — pre-ES6"),
        (r"function\s*\(", "ES5", "traditional function syntax"),
        (r"\.then\s*\(", "ES6", "promise chains — consider async/await"),
        (r"\bXMLHttpRequest\b", "ES5", "XHR — replaced by fetch()"),
        (r"prototype\.", "ES5", "prototype-based OOP — pre-class syntax"),
        (r"\brequire\s*\(", "CJS", "CommonJS require — consider ES modules"),
        (r"const\s+\w+\s*=\s*\(", "ES6+", "const declarations — ES6+"),
        (r"=>\s*[{(]", "ES6+", "arrow functions — ES6+"),
        (r"\basync\s+function\b", "ES8+", "async/await — ES2017+"),
        (r"import\s+.*from\s+['\"]", "ESM", "ES modules"),
    ),
    "Java": (
        (r"ArrayList\s+\w+\s*=\s*new\s+ArrayList\s*\(\)", "Java7-", "raw ArrayList — use generics"),
        (r"for\s*\(\s*(int|String)\s+\w+\s*=\s*0", "Java7-", "old-style for loop"),
        (r"StringBuffer\s+", "Java7-", "StringBuffer — use StringBuilder"),
        (r"System\.out\.println", "Java7-", "System.out.println — use a logger"),
        (r"@Override\s+public", "Java5+", "@Override annotation"),
        (r"List<|Map<|Set<", "Java5+", "generics — Java 5+"),
        (r"Optional\.", "Java8+", "Optional — Java 8+"),
        (r"\bstream\(\)\.", "Java8+", "Streams API — Java 8+"),
        (r"var\s+\w+\s*=", "Java10+", "local variable type inference — Java 10+"),
    ),
}

# Rank of the eras, the oldest first.
ERA_RANK = {
    "ES5": 1, "CJS": 1, "Java7-": 1, "2.x": 1, "ES6": 2, "Java5+": 2, "3.5+": 2, "ES6+": 3, "3.6+": 3, "Java8+": 3,
    "ES8+": 4, "ESM": 4, "3.8+": 4, "Java10+": 4, "3.10+": 5,
}

# The key under which a language's modernisation rules are filed; other languages by their lower-case name.
RULE_KEYS = {
    "Python": "python", "JavaScript": "javascript", "TypeScript": "javascript", "Java": "java", "Go": "go", "Ruby": "ruby",
    "Rust": "rust", "C++": "cpp", "C": "c", "C#": "csharp", "PHP": "php", "Kotlin": "kotlin", "Swift": "swift",
    "Scala": "scala", "R": "r", "Bash": "bash", "SQL": "sql",
}

# Line rules (expression, severity, issue), all without regard to case.
GENERIC_SCAN = (
    (r"password\s*=\s*[\"'][^\"']{4,}[\"']", "HIGH", "Possible hardcoded password"),
    (r"api_key\s*=\s*[\"'][^\"']{8,}[\"']", "HIGH", "Possible hardcoded API key"),
    (r"secret\s*=\s*[\"'][^\"']{8,}[\"']", "HIGH", "Possible hardcoded secret"),
    (r"[\"']\s*\+\s*\w+\s*\+\s*[\"'].*SELECT", "HIGH", "Possible SQL injection via concatenation"),
    (r"execute\s*\(\s*[\"'][^\"']*[\"'\s]\s*\+", "HIGH", "Possible SQL injection"),
    (r"innerHTML\s*=", "MEDIUM", "Possible XSS via innerHTML"),
    (r"document\.write\s*\(", "MEDIUM", "Possible XSS via document.write"),
    (r"exec\s*\(\s*[\"'].*\$", "HIGH", "Possible command injection"),
    (r"eval\s*\(", "HIGH", "Use of eval() — potential code injection"),
    (r"\bmd5\b|\bsha1\b", "MEDIUM", "Weak hashing algorithm"),
    (r"http://", "LOW", "Insecure HTTP — consider HTTPS"),
)
PYTHON_SCAN = (
    (r"\beval\s*\(", "HIGH", "Use of eval()"),
    (r"\bexec\s*\(", "HIGH", "Use of exec()"),
    (r"subprocess.*shell\s*=\s*True", "HIGH", "subprocess with shell=True"),
    (r"pickle\.load\b|yaml\.load\b", "HIGH", "Insecure deserialization"),
    (r"hashlib\.md5|hashlib\.sha1", "MEDIUM", "Weak hash algorithm"),
    (r"assert\s+", "LOW", "Assert used for security check"),
    (r"%\s*\([^)]*\)\s*%\s*\w", "MEDIUM", "String formatting in SQL-like context"),
)

# Secret rules (expression, whether case is ignored).
SECRETS = (
    (r"[A-Z0-9]{20}[A-Z0-9/+]{20,}", False),
    (r"ghp_[a-zA-Z0-9]{36}", False),
    (r"sk-[a-zA-Z0-9]{32,}", False),
    (r"password\s*[:=]\s*\S{8,}", True),
)

# Literals that show input or output, by type.
IO_SIGNATURES = {
    "network": (
        "requests", "urllib", "urllib2", "urllib3", "httpx", "aiohttp", "fetch", "axios", "XMLHttpRequest", "http.get", "http.post",
        "socket", "websocket", "grpc", "HttpClient", "RestTemplate", "okhttp", "retrofit", "net/http", "curl",
    ),
    "database": (
        "cursor", "execute", "fetchone", "fetchall", "commit", "rollback", "query", "findOne", "findAll", "save", "delete", "update",
        "mongoose", "sequelize", "prisma", "sqlalchemy", "psycopg2", "pymongo", "redis", "elasticsearch", "DatabaseHelper",
        "EntityManager", "Repository", "JdbcTemplate", "hibernate", "db.query", "db.exec", "db.run", "pool.query",
    ),
    "file_io": (
        "open(", "read(", "write(", "close(", "os.path", "pathlib", "fs.readFile", "fs.writeFile", "fs.readdir", "FileReader",
        "FileWriter", "BufferedReader", "Files.read", "Files.write", "fopen", "fread", "fwrite", "fclose", "shutil",
    ),
    "subprocess": (
        "subprocess", "os.system", "os.popen", "exec(", "eval(", "spawn", "fork", "child_process", "Runtime.exec", "ProcessBuilder", "popen",
    ),
}

# Standard-library roots by language.
STDLIB = {
    "python": (
        "os", "sys", "re", "json", "math", "time", "datetime", "collections", "itertools", "functools", "pathlib", "shutil",
        "subprocess", "threading", "multiprocessing", "socket", "http", "urllib", "email", "logging", "unittest", "typing", "abc",
        "io", "struct", "hashlib", "hmac", "base64", "copy", "pprint", "traceback", "inspect", "ast", "dis", "pickle", "csv", "xml",
        "html", "tempfile", "glob", "fnmatch", "random", "statistics", "decimal", "fractions", "enum", "dataclasses", "contextlib",
        "warnings", "gc", "weakref", "platform", "signal",
    ),
    "javascript": (
        "fs", "path", "os", "http", "https", "net", "crypto", "stream", "events", "util", "url", "querystring", "buffer",
        "child_process", "cluster", "readline", "repl", "vm", "zlib", "assert", "console", "process", "module", "require", "timers",
        "dns", "dgram",
    ),
    "java": (
        "java.lang", "java.util", "java.io", "java.net", "java.nio", "java.math", "java.time", "java.text", "java.security", "java.sql",
        "java.awt", "java.swing", "java.beans",
    ),
}

# Module keywords of input and output in the risk evidence.
IO_KEYWORDS = ("socket", "requests", "urllib", "http", "db", "sql", "redis", "mongo", "file", "open", "io")

# Risk tables. Hours that a change saves, 0.25 otherwise; types safe to apply; types that need care.
HOURS = {
    "print_statement": 0.1, "string_format_percent": 0.2, "urllib2_usage": 0.5, "has_key_removal": 0.1, "xrange_usage": 0.1,
    "var_declaration": 0.1, "arrow_function": 0.2, "promise_chain": 0.5, "raw_type": 0.3,
}
HOURS_OTHERWISE = 0.25
SAFE_TYPES = ("print_statement", "string_format_percent", "has_key_removal", "xrange_usage")
RISKY_TYPES = ("urllib2_usage", "promise_chain", "class_inheritance")

# Modernisation rules by language key, in order: (legacy, modern, pattern).
GOLDEN = {
    "python": (
        ("print 'hello'", "print('hello')", "print_statement"),
        ('print "hello"', 'print("hello")', "print_statement"),
        ("xrange(10)", "range(10)", "xrange_usage"),
        ("xrange(0, n)", "range(0, n)", "xrange_usage"),
        ("dict.has_key('key')", "'key' in dict", "has_key_removal"),
        ("d.has_key(k)", "k in d", "has_key_removal"),
        ("import urllib2", "import urllib.request as urllib2", "urllib2_usage"),
        ("urllib2.urlopen(url)", "urllib.request.urlopen(url)", "urllib2_usage"),
        ('"%s" % var', 'f"{var}"', "string_format_percent"),
        ("except Exception, e:", "except Exception as e:", "old_except_syntax"),
        ("raw_input(", "input(", "raw_input_usage"),
        ("basestring", "str", "basestring_usage"),
        ("reduce(", "functools.reduce(", "reduce_builtin"),
        ("filter(", "list(filter(", "filter_builtin"),
        ("map(lambda x:", "[x", "map_lambda"),
    ),
    "javascript": (
        ("var ", "const ", "var_declaration"),
        ("function() {", "() => {", "arrow_function"),
        ("function(x) {", "(x) => {", "arrow_function"),
        (".then(function(", "async function", "promise_chain"),
        ("new XMLHttpRequest()", "fetch(", "xhr_to_fetch"),
        ('"string" + variable', "`string${variable}`", "template_literal"),
        ("== null", "=== null", "strict_equality"),
        ("!= undefined", "!== undefined", "strict_equality"),
        ("Object.assign({},", "{ ...", "spread_operator"),
        ("require('", "import ", "commonjs_to_esm"),
    ),
    "java": (
        ("ArrayList list = new ArrayList()", "ArrayList<Object> list = new ArrayList<>()", "raw_type"),
        ("StringBuffer ", "StringBuilder ", "stringbuffer_to_builder"),
        ("System.out.println(", "logger.info(", "system_out_logging"),
        ("for (int i = 0; i < list.size(); i++)", "for (var item : list)", "enhanced_for"),
        ("if (obj == null)", "Optional.ofNullable(obj)", "optional_usage"),
        ("new Integer(", "Integer.valueOf(", "autoboxing"),
        ("catch (Exception e) {}", "catch (Exception e) { logger.error(", "empty_catch"),
    ),
    "go": (
        ("errors.New(fmt.Sprintf(", "fmt.Errorf(", "error_formatting"),
        ("if err != nil { return err }", 'if err != nil { return fmt.Errorf("context: %w", err) }', "error_wrapping"),
        ("ioutil.ReadFile(", "os.ReadFile(", "ioutil_deprecated"),
        ("ioutil.WriteFile(", "os.WriteFile(", "ioutil_deprecated"),
    ),
    "ruby": (
        ("has_key?", "key?", "hash_has_key"),
        ("Array.new.each", "[].each", "array_literal"),
        ("lambda {|x|", "->(x) {", "lambda_syntax"),
    ),
    "rust": (("try!(", "?", "try_macro"), ("Box::new(", "Box::new(", "heap_allocation")),
    "cpp": (("NULL", "nullptr", "null_pointer"), ("auto_ptr<", "unique_ptr<", "smart_pointer"), ("printf(", "std::cout <<", "printf_to_cout")),
    "csharp": (("ArrayList ", "List<object> ", "generic_collections"), ("String.Format(", '$"', "string_interpolation")),
    "php": (("mysql_query(", "PDO->query(", "mysql_deprecated"), ("ereg(", "preg_match(", "ereg_deprecated")),
}

# Layers of a run, in order, and the labels that the trace shows for them.
LAYERS = (
    "language_detector", "ast_parser", "security_scanner", "reader_agent", "modernizer_agent", "diff_engine", "chunk_validator",
    "test_runner", "risk_scorer", "evaluation_engine", "documenter_agent",
)
LAYER_LABELS = {
    "language_detector": "Language Detection", "ast_parser": "AST Parsing", "security_scanner": "Security Scan",
    "reader_agent": "Reader Agent", "modernizer_agent": "Modernizer Agent", "diff_engine": "Diff Engine",
    "chunk_validator": "Chunk Validator", "test_runner": "Test Runner", "risk_scorer": "Risk Scorer",
    "evaluation_engine": "Evaluation Engine", "documenter_agent": "Documenter Agent", "complete": "Complete",
}
