"""Formats, patterns and word lists that results depend on.

They are conventions of the tools whose output is read (test runners, package
managers, linters, version control) and limits of the documented behaviour; they
are stated here once, as text, and used everywhere else by name.
"""

# ---- fixed values ----
MARK = "[skein:"
MIN_CHARS = 500
TEE_MIN_BYTES = 4096
MAX_CHARS, HEAD_LINES, TAIL_LINES = 40000, 150, 250
READ_LINE_LIMIT = 2000
COUNT_CAP_BYTES = 5 * 1024 * 1024
GLOB_MIN_NAMES, GLOB_SHOWN = 100, 50
ARRAY_MIN, ARRAY_SHOWN = 50, 10
BASE64_SHOWN = 64
RUN_MIN, MATCH_RUN_SHOWN, DIAGNOSTIC_SHOWN, CONTEXT_SHOWN = 4, 3, 3, 3
PREFIX_UNITS = 16
CHARS_PER_TOKEN, USD_PER_MILLION_TOKENS = 3, 3
RETENTION_DAYS, GRAPH_DAYS, TOP_COMMANDS, TOP_DISCOVER = 90, 30, 10, 15
MAX_FILTERS, MAX_CONFIG_BYTES, MAX_PATTERN = 50, 256 * 1024, 256

ANSI_ESCAPE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~]|\][^\x07]*(?:\x07|\x1B\\))"
ANSI_LITERAL = r"(?i)\\u001b\[[0-?]*[ -/]*[@-~]"
CARRIAGE = r"\r|\\r"

PROGRESS = (
    r"^[|/\\-]$",
    r"(?i)^[|/\\-]\s+(?:[\d\[]|(?:downloading|extracting|pulling|waiting|verifying)(?:\s|$))",
    r"\[[=>#.\-\s]{8,}\]\s*\d{1,3}%?",
    r"(?i)\b(?:Downloading|Extracting|Pulling fs layer|Waiting|Verifying Checksum)\b.*\[[=>#.\-\s]{8,}\]",
    r"(?i)\b(?:npm|pip|cargo|docker|yarn|pnpm)\b.*\b\d{1,3}%\b",
    r"(?i)^(?:progress|download(?:ing)?|reify|fetch)\b.*\b\d{1,3}%",
)
BUILD_PROGRESS = r"(?i)^(?:Compiling|Checking|Building)\s+\S+"

FINGERPRINT = (
    (r"reify:[^:\s]+: timing reifyNode:node_modules/\S+", "reify:<pkg>: timing reifyNode:node_modules/<pkg>"),
    (r"(?i)\b[0-9a-f]{7,64}\b", "<hex>"),
    (r"(?i)\b(?:id|sha|hash)=[0-9a-f]{3,64}\b", "<id>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<uuid>"),
    (r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?\b", "<timestamp>"),
    (r"\b\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\b", "<time>"),
    (r"(?i)\b\d+(?:\.\d+)?\s?(?:ms|s|kB|MB|MiB|KiB|B)\b", "<num><unit>"),
    (r"\b\d+(?:\.\d+)?\b", "<num>"),
)

FAILURE = r"(?m)(?:^Error:\s|^error(?:\[[A-Z]\d+\])?:|^fatal:\s|^npm ERR!(?:\s|$)|^FAIL(?:ED)?\b|(?<!0 )\bFAILED\b|\bpanicked at\b|\bAssertionError(?::|\b)|\b[1-9]\d*\s+(?:[Ff][Aa][Ii][Ll][Ee][Dd]|[Ee][Rr][Rr][Oo][Rr][Ss]?)\b)"

TEST_SIGNAL = r"(?:^(?:PASS|FAIL)\s+\S+|^ok\s+\d|^not ok\s|^\d+ passing\b|^Test Suites:|^Test Files\s|^test result:|^=+ .* (?:passed|failed).* =+$|^(?:PASSED|FAILED|ERROR)\s*:|^.*::\S+\s+(?:PASSED|FAILED|ERROR|SKIPPED)\s*$)"
TEST_SUMMARY = r"^(?:Test Suites:|Test Files\s|Tests\s+|Duration\b|test result:|=+ .* (?:passed|failed).* =+$|\d+\s+(?:passed|failed|skipped|error|errors|failures?)\b)"
SUMMARY_KEPT = r"(?i)(?:\b\d+\s+(?:failed|passed|skipped|error|errors|failures?|tests?|test files?)\b|Test Files|Tests|Duration|test result:|^ok\s+|^FAIL\b|^PASS\b|compiled with|Finished\b)"
FAIL_LINE = r"\b(?:FAILED|FAIL|failed|panicked|panic|AssertionError|Error:|Exception:)\b"
PASS_WORD = r"\b(?:PASSED|PASS|ok)\b"
FAILURES_BANNER = r"(?i)^=+\s*(?:FAILURES|short test summary info)\s*=+$"
RESULT_BANNER = r"(?i)^=+.*(?:failed|passed|skipped|error).*=+$"
FAIL_HEAD = r"^\s*(?:\\u001b\[[0-9;]*m)?(?:FAIL|FAILED)\b|\bFAILED$|^\s*FAILED\s+"

TRACE_START = r"^Traceback \(most recent call last\):|^\s*(?:at\s+\S|File \".*\", line \d+)"
TRACE_END = r"(?:Error|Exception|AssertionError|RuntimeError|ValueError|TypeError|ReferenceError|SyntaxError|panic|fatal):"
FRAME = r"^\s*(?:File \"|at\s+)"
FRAME_BODY = r"^\s{4}\S"
IMPORTANT = r"(?i)error|fail|exception|warning|fatal|panic"

STATUS_LINE = r"^[ MADRCU?!]{2}\s"
LOG_VERBATIM_FLAG = r"^(?:-p|-u|--patch(?:=|$)|--stat(?:=|$)|--graph(?:=|$)|--name-status(?:=|$)|--name-only(?:=|$)|--line-range(?:=|$)|-(?:L|S|G))"
ONE_LINE_LOG = r"^[0-9a-f]{7,40}\s+\S"
COMMIT_LINE = r"(?i)^commit\s+([0-9a-f]{7,40})\b"
AUTHOR_OR_DATE = r"^(?:Author|Date):"
DIFF_META = r"^(?:index |old mode |new mode |new file mode |deleted file mode )"
DIFF_LIVE = r"^(?:diff --git |@@|\+|-)"
PACKAGE_SUMMARY = r"(?i)(?:added|removed|changed|audited)\s+\d+\s+(?:packages?|dependencies)|Successfully installed|Finished\s+(?:dev|release)|Downloaded\s+\d+\s+packages?"
PACKAGE_SIGNAL = r"(?i)\bwarn\b|deprecat|vulnerabilit|peer dep|EBADENGINE|ERESOLVE"
RUNNER_SUMMARY = r"(?i)(?:Test Files|Tests\s+\d+|\d+ examples?, \d+ failures?|\d+ passed|test result: ok|^PASS\s*$)"
LINT_SUCCESS = r"(?i)(?:no problems|found 0 errors|all checks passed)"
LINT_HEADING = r"^(?:/|[\w.-]+/)[\w./-]+\.[\w]+$"
LINT_TSC = r"(?i)^(.+?)\((\d+(?:,\d+)?)\):\s*(error|warning)\s+(.+)$"
LINT_TSC_RULE = r"\b(TS\d+|[A-Z]\d{3,4})\b"
LINT_STYLISH = r"(?i)^\s*(\d+:\d+)\s+(warning|error)\s+(.+?)\s{2,}([\w/@-]+)\s*$"
LINT_CONCISE = r"^(.+?):(\d+):(\d+):\s*([A-Z]\d+)\s+(.+)$"
MATCH_PATH = r"^([^\n]+?):\d+:"
MATCH_PLACE = r"^(.+?:\d+):"

UNSAFE_SHELL = r"\$\(|`|[\r\n<>;|&]"
ENV_ASSIGNMENT = r"^[A-Za-z_][A-Za-z0-9_]*="
VERBOSE_FLAG = r"^(?:-v+$|--verbose(?:=|$)|--debug(?:=|$)|--loglevel(?:=|$))"
SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._+-]{0,63}$"
SUBCOMMAND_TOOLS = "cargo composer docker gh git go gradle helm kubectl mvn npm pip pip3 pnpm terraform yarn".split()
KNOWN_EXECUTABLES = "cargo docker eslint git go jest kubectl npm pip pip3 pnpm pytest rspec ruff tsc vitest yarn".split()
LAUNCHER_VALUE_FLAGS = "-c --call -p --package".split()
PACKAGE_MANAGERS = "npm pnpm yarn pip pip3 cargo".split()
TEST_BINARIES = "go jest vitest rspec pytest cargo npm pnpm yarn".split()
LINTERS = "eslint tsc ruff".split()
QUIET_GIT = "push fetch add commit".split()

DATA_BASE64 = r"data:[^,;\s]+;base64,[A-Za-z0-9+/]+={0,2}"
RAW_BASE64 = r"[A-Za-z0-9+/]{1022,}={1,2}"
# ---- end of fixed values ----
