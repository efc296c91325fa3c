"""Ignore rules in the syntax of .gitignore files, compiled to regular expressions that Java and RE2 share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Files and directories that are always ignored.
DEFAULTS = tuple(
    "*.env *.env.* .env* config.json config.yaml config.yml settings.json appsettings.json appsettings.*.json *.key *.pem *.p12 *.pfx *.crt *.cer *.jks *.keystore *.truststore "
    "*.db *.sqlite *.sqlite3 *.mdb *.accdb *.secret *.secrets auth.json *.token *.bak *.backup *.old *.orig docker-compose.override.yml docker-compose.override.yaml "
    "id_rsa id_dsa id_ecdsa id_ed25519 *.ppk *.gpg *.DS_Store *-lock.json *.lock *.log *.ttf *.png *.jpg *.jpeg *.gif *.mp4 *.svg *.ico *.pdf *.zip *.gz *.tar *.dmg *.tgz "
    "*.rar *.7z *.exe *.dll *.obj *.o *.o.d *.a *.lib *.so *.dylib *.ncb *.sdf *.woff *.woff2 *.eot *.cur *.avi *.mpg *.mpeg *.mov *.mp3 *.mkv *.webm *.jar *.onnx *.parquet *.pqt "
    "*.wav *.webp *.wasm *.plist *.profraw *.gcda *.gcno go.sum *.gitignore *.gitkeep *.continueignore *.csv *.uasset *.pdb *.bin *.pag *.swp *.jsonl "
    ".env/ env/ .aws/ .gcp/ .azure/ .kube/ .docker/ secrets/ .secrets/ private/ .private/ certs/ certificates/ keys/ .ssh/ .gnupg/ .gpg/ tmp/secrets/ temp/secrets/ .tmp/ "
    ".git/ .svn/ node_modules/ dist/ build/ Build/ target/ out/ bin/ .pytest_cache/ .vscode-test/ __pycache__/ site-packages/ .gradle/ .mvn/ .cache/ gems/ vendor/ .venv/ venv/ "
    ".vscode/ .idea/ .vs/ .continue/".split()
)


def parse(content: str) -> list[str]:
    """The patterns of an ignore file: lines stripped, without comments and empty ones."""
    return [x for x in (line.strip() for line in re.split(r"\r?\n", content)) if x and not x.startswith("#")]


def _glob(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := part.find("]", i + 2)) > 0:
            body = part[i + 1 : end]
            out += "[" + ("^" if body[0] in "!^" else "") + body.lstrip("!^").replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(c) if not c.isalnum() and c not in "_-/" else c
        i += 1
    return out


def to_regex(pattern: str) -> tuple[str, bool]:
    """(expression for a path relative to the pattern's file, whether it ignores). Directories are written with a slash at the end."""
    keeps = pattern.startswith("!")
    body = pattern[1:] if keeps or pattern.startswith(("\\!", "\\#")) else pattern
    only_dir = body.endswith("/")
    body = body.rstrip("/") if only_dir else body
    anchored = "/" in body
    parts = body.lstrip("/").split("/")
    out = "^" if anchored else "^(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _glob(part) + ("" if last else "/")
    return out + ("/" if only_dir else "(?:/|$)"), not keeps


def compile_rules(patterns: list[str]) -> list[tuple[str, bool]]:
    return [to_regex(p) for p in patterns]


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last rule that matches the path ignores it; runs of rules of one kind are one expression."""
    out = F.lit(False)
    for expression, ignores in merged(patterns):
        out = F.when(path.rlike(expression), F.lit(ignores)).otherwise(out)
    return out


def merged(patterns: list[str]) -> list[tuple[str, bool]]:
    runs: list[tuple[list[str], bool]] = []
    for expression, ignores in compile_rules(patterns):
        if runs and runs[-1][1] == ignores:
            runs[-1][0].append(expression)
        else:
            runs.append(([expression], ignores))
    return [("|".join(f"(?:{e})" for e in es), ignores) for es, ignores in runs]


class Context:
    """The rules of one directory: those of its ignore file, then the defaults, which so win over exceptions."""

    def __init__(self, ignore_file: str | None = None, more: list[str] | None = None):
        self.patterns = [*(parse(ignore_file) if ignore_file else []), *(more or []), *DEFAULTS]
        self._compiled = [(re.compile(e), i) for e, i in compile_rules(self.patterns)]

    def ignores(self, path: str) -> bool:
        out = False
        for expression, ignores in self._compiled:
            if out != ignores and expression.search(path.lstrip("/")):
                out = ignores
        return out
