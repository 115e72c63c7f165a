"""The rule bank: 22 fixed rules as predicates over the views of a line, in emission order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.functions.credentials import SecretAssignment
from glintsieve.functions.predicates import Flag, In, Literal, Match, Predicate, calls, commands, flag, holds, tokens

RANKS = {"info": 0, "medium": 1, "high": 2}
SARIF_LEVELS = {"info": "note", "medium": "warning", "high": "error"}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    severity: str
    message: str
    languages: str
    gate: tuple[str, ...]  # syntax facts needed on the line of a parsed file: C call, S assignment or pair, I identifier, U unsafe
    predicate: Predicate
    flow_only: bool = False
    config: bool = False
    sink: bool = False


# --- fixed values --------------------------------------------------------------------------------
C_STRINGS = ["gets", "strcpy", "strcat", "sprintf", "vsprintf"]
C_COPIES = ["memcpy", "memmove"]
EVALS = {"javascript": ["eval", "Function"], "python": ["eval", "exec"], "php": ["eval"]}
RUBY_EVALS = ["eval", "class_eval", "instance_eval", "module_eval"]
COMMANDS = {
    "c": ["system", "popen"],
    "csharp": ["Process.Start"],
    "javascript": ["child_process.exec", "child_process.execSync", "shelljs.exec", "execa", "Bun.spawn", "Deno.Command"],
    "go": ["exec.Command", "exec.CommandContext", "syscall.Exec"],
    "jvm": ["ProcessBuilder", "Runtime.getRuntime().exec"],
    "php": ["exec", "passthru", "popen", "proc_open", "shell_exec", "system"],
    "python": ["os.popen", "os.system", "subprocess.call", "subprocess.check_call", "subprocess.check_output", "subprocess.Popen", "subprocess.run", "os.execv", "os.execve", "os.execvp", "os.execvpe", "os.spawnv", "os.spawnve", "os.spawnvp", "pty.spawn", "commands.getoutput"],
    "rust": ["Command::new"],
    "swift": ["Process"],
}
RUBY_COMMANDS = ["exec", "spawn", "system"]
DESERIALIZERS = {
    "jvm": ["readObject", "enableDefaultTyping", "activateDefaultTyping"],
    "php": ["unserialize"],
    "python": ["pickle.load", "pickle.loads", "yaml.load", "yaml.unsafe_load", "dill.load", "dill.loads", "joblib.load", "jsonpickle.decode", "marshal.loads"],
}
CSHARP_FORMATTERS = ["new BinaryFormatter", "new LosFormatter", "new ObjectStateFormatter"]
CSHARP_REACH = 20
WEAK_CRYPTO = ["MD5", "md5", "SHA1", "sha1", "SHA-1", "DES", "TripleDES", "3DES", "RC4", "rc4", "ECB", "MODE_ECB"]
CRYPTO_FACTORIES = ["MessageDigest.getInstance", "Cipher.getInstance", "crypto.createHash", "createHash", "hashlib.new"]
RANDOMS = {"javascript": ["Math.random"], "c": ["rand", "srand"], "python": ["random.random", "random.randint", "random.randrange"], "jvm": ["java.util.Random", "Random"], "php": ["mt_rand", "rand"]}
TLS_FLAGS = [("verify", "False"), ("rejectUnauthorized", "false"), ("InsecureSkipVerify", "true"), ("check_hostname", "False"), ("CURLOPT_SSL_VERIFYPEER", "false"), ("CURLOPT_SSL_VERIFYHOST", "0")]
SQL_APIS = ["execute", "executemany", "query", "rawQuery", "createStatement", "raw", "prepare", "$queryRawUnsafe", "$executeRawUnsafe"]
SQL_QUALIFIED = ["knex.raw", "sequelize.query", "db.run"]
PATH_APIS = ["open", "fopen", "readFile", "readFileSync", "File", "File.open", "File::open", "read_to_string", "file_get_contents"]
PUBLIC_PREFIXES = ["NEXT_PUBLIC_", "VITE_", "REACT_APP_"]
OUTBOUND = ["requests.get", "requests.post", "requests.request", "fetch", "axios.get", "axios.post", "http.Get"]
NOSQL = ["collection.find", "collection.findOne", "mongoose.find"]
AGENT_TOOLS = ["PythonREPLTool", "PythonAstREPLTool", "ShellTool", "BashProcess"]
COOKIE_FLAGS = ["secure:false", "secure=False", "httpOnly:false", "httponly=False", "cookie.secure=false"]


def _by_language(table: dict[str, list[str]]) -> Predicate:
    parts = [In((language,)) & calls(*names) for language, names in table.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out | part
    return out


def _tls() -> Predicate:
    out = flag(*TLS_FLAGS[0])
    for name, value in TLS_FLAGS[1:]:
        out = out | flag(name, value)
    out = out | tokens("SSL_VERIFY_NONE")
    out = out | (tokens("NODE_TLS_REJECT_UNAUTHORIZED", "process.env") & Match("visible", r"NODE_TLS_REJECT_UNAUTHORIZED[^=:]*[=:]\s*['\"]?\s*0\s*['\"]?\s*;*\s*$"))
    out = out | (tokens("HostnameVerifier") & holds("code", "return true"))
    return out | (calls("checkServerTrusted") & Match("compact", r"^[^)]*\)\{\}$"))


_SECRET = SecretAssignment()
_SQL_TEXT = Literal(r"(?i)^\s*(?:SELECT|INSERT|UPDATE|DELETE) ")
_JOINED = Match("code", r"[+%]") | Match("visible", r"\$\{|f\"|f'|\$\"") | (In(("php",)) & holds("code", " . "))
_WEAK = tokens(*WEAK_CRYPTO) | (calls(*CRYPTO_FACTORIES) & Literal(r"(?i)(?:^|/)(?:MD5|SHA1|SHA-1|DES|TripleDES|3DES|RC4|ECB|MODE_ECB)(?:/|$)"))
_WEAK = (_WEAK & ~(In(("python",)) & flag("usedforsecurity", "False"))) | tokens("crypto.createCipher")
_JWT = ((holds("code", "jwt") | holds("visible", "verify_signature")) & (Match("compact", r"verify(?:=False|:false)") | (holds("visible", "verify_signature") & Match("compact", "[Ff]alse")))) | (holds("visible", "algorithms") & Literal("^none$"))
_CORS = holds("visible", "Access-Control-Allow-Origin", "origin") & Literal(r"^\*$") & holds("compact", "credentials:true", "supports_credentials=True")
_COOKIE = (Match("code", "(?i)cookie") | holds("code", "session")) & holds("compact", *COOKIE_FLAGS)
_HTML = holds("compact", ".innerHTML=", "dangerouslySetInnerHTML", "v-html") | calls("render_template_string", "document.write")
_FORMATTER = In(("csharp",)) & Flag("formatter_near") & calls("Deserialize")
_DESERIALIZE = _FORMATTER | _by_language(DESERIALIZERS) | (In(("ruby",)) & commands(*["Marshal.load"])) | (calls("torch.load") & holds("compact", "weights_only=False"))

WEB = "web sources and configuration"
RULES = [
    Rule("SR001", "unbounded-string-copy", "high", "A C string function without a length can write past its buffer; pass and check the size of the destination.", "C, C++", ("C",), In(("c",)) & calls(*C_STRINGS)),
    Rule("SR002", "raw-memory-copy", "info", "A raw memory copy needs its length, the capacity of the destination and overlap looked at.", "C, C++", ("C",), In(("c",)) & calls(*C_COPIES)),
    Rule("SR003", "unsafe-block", "medium", "Unsafe Rust needs a written invariant and tests of its own.", "Rust", ("U",), In(("rust",)) & tokens("unsafe")),
    Rule("SR004", "dynamic-evaluation", "high", "Text is run as code; check who can influence it.", "JavaScript, TypeScript, Python, PHP, Ruby", ("C",), _by_language(EVALS) | (In(("ruby",)) & commands(*RUBY_EVALS)), sink=True),
    Rule("SR005", "command-execution", "medium", "An operating-system command is started; check the separation of arguments, the shell and the input.", "all but configuration", ("C",), _by_language(COMMANDS) | (In(("ruby",)) & commands(*RUBY_COMMANDS)), sink=True),
    Rule("SR006", "object-deserialization", "high", "Objects are built from data that may come from outside; use a plain format or an allowlist.", "Python, Java, Kotlin, C#, PHP, Ruby", ("C",), _DESERIALIZE, sink=True),
    Rule("SR007", "embedded-credential", "high", "A credential is written in the source; store it elsewhere and rotate it. The line is not shown.", "all", ("S",), _SECRET, config=True),
    Rule("SR008", "weak-cryptography", "medium", "A weak cryptographic primitive; check what it protects.", "all", ("C", "I", "S"), _WEAK),
    Rule("SR009", "weak-randomness", "info", "Random numbers that can be predicted; check that nothing secret depends on them.", "C, C++, JavaScript, TypeScript, Python, Java, Kotlin, PHP", ("C",), _by_language(RANDOMS)),
    Rule("SR010", "certificate-check-off", "high", "Certificates or host names are not verified.", "all", ("C", "S"), _tls()),
    Rule("SR011", "assembled-sql", "medium", "SQL is put together from parts; use parameters.", "all", ("C",), _SQL_TEXT & calls(*SQL_APIS) & _JOINED, sink=True),
    Rule("SR012", "variable-path", "medium", "A file path depends on a variable; confine it to its folder.", "all", ("C",), Flag("path_call"), flow_only=True, sink=True),
    Rule("SR013", "public-credential", "high", "A credential is in configuration that clients receive.", WEB, ("C", "S"), holds("code", *PUBLIC_PREFIXES) & _SECRET, config=True),
    Rule("SR014", "debug-enabled", "high", "Debug mode is switched on.", WEB, ("C", "S"), holds("compact", "debug=True", "DEBUG=True", "debug:true", "DEBUG=true"), config=True),
    Rule("SR015", "html-from-input", "high", "Input reaches HTML; encode it or use a reviewed sanitizer.", WEB, ("C", "S"), _HTML, flow_only=True, sink=True),
    Rule("SR016", "url-from-input", "high", "Input reaches the address of a request; restrict where requests may go.", WEB, ("C",), calls(*OUTBOUND), flow_only=True, sink=True),
    Rule("SR017", "unverified-token", "high", "The verification of signed tokens is weakened.", WEB, ("C", "S"), _JWT, config=True),
    Rule("SR018", "open-cors", "high", "Any origin may send credentials.", WEB, ("C", "S"), _CORS, config=True),
    Rule("SR019", "cookie-flags-off", "high", "A cookie's protection is switched off.", WEB, ("C", "S"), _COOKIE, config=True),
    Rule("SR020", "service-role-key", "high", "A service-role credential is written in the source.", WEB, ("C", "S"), Match("code", "(?i)service_role") & _SECRET, config=True),
    Rule("SR021", "nosql-from-input", "high", "Input reaches a raw NoSQL query; validate its shape.", WEB, ("C", "S"), holds("visible", "$where") | calls(*NOSQL), flow_only=True, sink=True),
    Rule("SR022", "agent-code-tool", "high", "A tool that runs code is given to an agent; confine and authorize it.", WEB, ("C",), calls(*AGENT_TOOLS)),
]
BY_ID = {rule.rule_id: rule for rule in RULES}
SINKS = [rule for rule in RULES if rule.sink]


def candidates() -> Column:
    """Ids of the rules that a line matches, in emission order."""
    return F.filter(F.array(*[F.when(rule.predicate.column(), F.lit(rule.rule_id)) for rule in RULES]), lambda x: x.isNotNull())


def table(spark: SparkSession) -> DataFrame:
    """The rules as a dimension: bounded by their number, safe to broadcast."""
    rows = [(r.rule_id, r.name, r.severity, RANKS[r.severity], SARIF_LEVELS[r.severity], r.message, r.languages, list(r.gate), r.flow_only, r.config, k) for k, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_id string, name string, severity string, severity_rank int, sarif_level string, message string, languages string, gate array<string>, flow_only boolean, config boolean, emit_ord int")


