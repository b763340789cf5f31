"""Rules on shell scripts: patterns over lines that are not comments, and the shared signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.rules.base import rule

# fixed values: signatures of credential paths, piped downloads, miners and drop hosts
SENSITIVE_PATHS = r"(?i)\.ssh/|\.aws/credentials|\.aws/config|/etc/(passwd|shadow)|\.bash_history|\.netrc|\.docker/config\.json|\.kube/config|cookies\.sqlite|Login Data|\.npmrc|\.pypirc"
PIPE_TO_SHELL = r"(?i)(curl|wget|fetch)\b.*\|\s*(sudo\s+)?((ba|z|da|c|k)?sh|python[23]?|perl|ruby|node|php)\b"
MINER = r"(?i)stratum\+?(tcp|ssl)://|xmrig|minergate|nicehash|coinhive|cryptonight"
EXFIL_URL = (
    r"(?i)https?://(?:[a-z0-9-]+\.)*(?:pastebin\.com/raw|hastebin\.com|ghostbin\.|dpaste\.|controlc\.com|webhook\.site|requestbin\.|pipedream\.net|"
    r"ngrok\.(?:io|app|dev)|localtunnel\.|trycloudflare\.com|transfer\.sh|0x0\.st|termbin\.com|anonfiles\.com|file\.io|oshi\.at|"
    r"discord(?:app)?\.com/api/webhooks|api\.telegram\.org/bot)"
)
BASE64_BLOB = r"^[A-Za-z0-9+/]{200,}={0,2}$"
HEX_BLOB = r"^(?:0x)?[0-9a-fA-F]{200,}$"
# fixed values: patterns of shell malware
REVERSE_SHELL = r"(?i)/dev/(?:tcp|udp)/|\bnc(?:at)?\b[^\n]*\s-[a-zA-Z]*e\b|\bncat\b[^\n]*--exec\b|\bmkfifo\b[^\n]*\|\s*(?:nc|sh|bash)\b|\bsocat\b[^\n]*\bexec:"
FORK_BOMB = r":\s*\(\s*\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:"
ENCODED_EXEC = (
    r"(?i)(?:base64\s+(?:-d|--decode|-D)|openssl\s+enc\b[^\n]*-d|\bxxd\s+-r)[^\n]*\|\s*(?:sudo\s+)?(?:ba|z|da|c|k)?sh\b"
    r"|\beval\b[^\n]*\$\([^\n]*\b(?:base64|xxd|openssl)\b"
)
DESTRUCTIVE = (
    r"(?i)\brm\s+-[a-z]*r[a-z]*f[a-z]*\s+(?:--no-preserve-root\s+)?/(?:\s|$|\*|\"|')|\brm\s+-[a-z]*f[a-z]*r[a-z]*\s+(?:--no-preserve-root\s+)?/(?:\s|$|\*|\"|')"
    r"|\bmkfs\.[a-z0-9]+\b|\bmkfs\s|\bdd\b[^\n]*\bof=/dev/(?:sd|nvme|hd|vd)|>\s*/dev/sd[a-z]"
)
NETWORK = r"(?i)\b(?:curl|wget|nc|ncat|scp|sftp|ftp|tftp)\b"
PERSISTENCE = (
    r"(?i)(?:>>?|\btee\b)[^\n|;&]*(?:\bauthorized_keys\b|\.bashrc\b|\.bash_profile\b|\.zshrc\b|\.profile\b|/etc/profile\.d/|/etc/rc\.local|/etc/cron|/var/spool/cron)"
    r"|\|\s*crontab\b|\bcrontab\s+[^\s-]\S*"
)
ANTIFORENSICS = (
    r"(?i)\bhistory\s+-c\b|\bunset\s+HISTFILE\b|\bHISTFILE=/dev/null\b|\bset\s+\+o\s+history\b|\bbash_history\b|\bsetenforce\s+0\b|\biptables\s+-F\b|\bufw\s+disable\b"
    r"|\bsystemctl\s+(?:stop|disable)\s+(?:auditd|rsyslog|syslog)\b|\bchattr\s+[+-]i\b|\b(?:rm|shred|truncate)\b[^\n]*\s/var/log/"
    r"|(?:^|[;|]|&&|\|\||:)\s*>\s*/var/log/|>\s*/var/log/(?:auth\.log|secure|syslog|messages|kern\.log|wtmp|btmp|lastlog|faillog|audit/)"
)
# token formats that providers publish
CREDENTIALS = (
    r"\bAKIA[0-9A-Z]{16}\b|\bASIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bgithub_pat_[A-Za-z0-9_]{50,}|\bglpat-[A-Za-z0-9_-]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}"
    r"|\bsk_live_[A-Za-z0-9]{20,}|\brk_live_[A-Za-z0-9]{20,}|\bsk-(?:ant-|proj-)?[A-Za-z0-9_-]{32,}|\bAIza[0-9A-Za-z_-]{35}\b|\bya29\.[0-9A-Za-z_-]{20,}|\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|\bnpm_[A-Za-z0-9]{36}\b|\bpypi-[A-Za-z0-9_-]{50,}|\bhf_[A-Za-z0-9]{30,}|\bdop_v1_[a-f0-9]{64}\b|\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
    r"|-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----|(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@]+:[^\s:/@]{3,}@[^\s/]+"
)


def lines_with(rule_id: str, category: str, severity: str, verdict: str, language: str, pattern: str) -> None:
    """A rule that is one pattern over lines."""

    def run(rows):
        return rows.where(F.col("text").rlike(pattern)).withColumn("evidence", F.col("text"))

    rule(rule_id, category, severity, verdict, language, when=lambda: (F.col("text").rlike(pattern), F.col("text")))(run)


for _id, _severity, _verdict, _pattern in (
    ("SH-MAL-CURL-BASH", "high", "auto", PIPE_TO_SHELL),
    ("SH-MAL-REVERSE-SHELL", "blocking", "auto", REVERSE_SHELL),
    ("SH-MAL-FORK-BOMB", "blocking", "auto", FORK_BOMB),
    ("SH-MAL-ENCODED-EXEC", "blocking", "auto", ENCODED_EXEC),
    ("SH-MAL-DESTRUCTIVE", "high", "candidate", DESTRUCTIVE),
    ("SH-MAL-PERSISTENCE", "high", "candidate", PERSISTENCE),
    ("SH-MAL-ANTIFORENSICS", "high", "candidate", ANTIFORENSICS),
    ("SH-MAL-CRYPTO-MINER", "high", "auto", MINER),
    ("SH-MAL-EXFIL-URL", "medium", "candidate", EXFIL_URL),
):
    lines_with(_id, "malware", _severity, _verdict, "shell", _pattern)

lines_with("SH-SECRET-DETECTED", "secrets", "high", "auto", "shell", CREDENTIALS)
lines_with("CFG-SECRET-DETECTED", "secrets", "high", "auto", "config", CREDENTIALS)


@rule("SH-MAL-CREDENTIAL-EXFIL", "malware", "high", "candidate", "shell")
def credential_exfil(lines):
    return lines.where(F.col("text").rlike(SENSITIVE_PATHS) & F.col("text").rlike(NETWORK)).withColumn("evidence", F.col("text"))


@rule("CFG-ENV-FILE-COMMITTED", "secrets", "blocking", "auto", "config")
def env_file(lines):
    name = F.element_at(F.split("path", "/"), -1)
    hit = name.rlike(r"^\.env(\.|$)") & ~name.rlike(r"(?i)(example|sample|template|dist)$")
    return lines.where(hit).groupBy("path").agg(F.lit(1).alias("line"), F.first(name).alias("evidence"))
