"""Path expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.canon import sha256


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)\z", 1)


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def _normal(path: Column) -> Column:
    p = forward_slashes(path)
    drive = F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))
    return F.when(p.rlike(r"^[A-Za-z]:/"), drive).otherwise(p)


def rel_path_of(cwd: Column, path: Column) -> Column:
    """C11: the path relative to cwd, or null when it does not lie beneath it."""
    root = F.concat(F.regexp_replace(_normal(cwd), r"/+\z", ""), F.lit("/"))
    p = _normal(path)
    rest = F.substr(p, F.length(root) + 1)
    return F.when(F.startswith(p, root) & (rest != ""), rest)


def display_path(path: Column, cwd: Column) -> Column:
    """Shorten paths beneath cwd; others stay as they were touched."""
    rest = F.regexp_replace(F.substr(path, F.length(cwd) + 1), r"^[\\/]+", "")
    inside = (cwd != "") & F.startswith(path, cwd) & (rest != "")
    return F.when(inside, forward_slashes(rest)).otherwise(path)


def path_key(machine_id: Column, cwd: Column) -> Column:
    """C14: sixteen hex digits naming a directory on a machine."""
    text = F.concat(F.coalesce(machine_id, F.lit("unknown")), F.lit("\0"), cwd)
    return F.substring(sha256(text), 1, 16)


def query_path(path: Column) -> Column:
    """How a user's path argument is read."""
    p = F.regexp_replace(forward_slashes(path), r"^\./", "")
    return F.regexp_replace(p, r"^/+", "")


def in_scope(root: Column, path: Column) -> Column:
    """P10: beneath the project root, and not the root itself."""
    base = F.concat(F.regexp_replace(_normal(root), r"/+\z", ""), F.lit("/"))
    p = _normal(path)
    return F.startswith(p, base) & (F.length(p) > F.length(base)) & ~p.rlike(r"(^|/)\.\.(/|\z)")


# ---- sensitive paths (P6). Fixed values -------------------------------------------
EXEMPT_SUFFIX = r"\.(example|sample|template|dist|tpl)\z"
ENV_FILE = r"^\.?env(\..+)?\z|\.env\z"
KEY_FILE = r"\.(pem|key|p12|pfx|jks|keystore|ppk|asc|gpg)\z|^id_(rsa|dsa|ecdsa|ed25519)\z"
SECRET_FILE = r"^secrets?\.(json|ya?ml|toml|ini)\z|\.tfvars\z|^service[-_]account.*\.json\z"
SENSITIVE_NAMES = (
    ".npmrc", ".netrc", "_netrc", ".pgpass", ".htpasswd", ".git-credentials", ".envrc", ".pypirc",
    ".dockercfg", ".terraformrc", ".npmrc.local", "kubeconfig", "credentials.json",
    "client_secret.json", "terraform.tfstate", "terraform.tfstate.backup",
)
# A file name that is sensitive only beneath one of these directories.
SENSITIVE_IN = {"credentials": (".aws", ".gcloud"), "config.json": (".docker",), "config": (".kube",)}


def is_sensitive_path(path: Column) -> Column:
    lower = F.lower(path)
    base = basename(lower)
    parts = F.split(lower, r"[\\/]")
    beneath = F.lit(False)
    for name, dirs in SENSITIVE_IN.items():
        inside = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in dirs]))
        beneath = beneath | ((base == name) & inside)
    return (
        F.when(base.rlike(EXEMPT_SUFFIX), False)
        .when(base.rlike(ENV_FILE), True)
        .when(base.endswith(".pub"), False)
        .otherwise(
            base.rlike(KEY_FILE) | base.isin(*SENSITIVE_NAMES) | beneath | base.rlike(SECRET_FILE)
        )
    )


# ---- ignore globs (P7) --------------------------------------------------------------
# Fixed value: what a recorder never watches unless told otherwise.
DEFAULT_IGNORE = (
    "**/.git/**", "**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**",
    "**/target/**", "**/__pycache__/**", "**/.venv/**", "**/*.log",
)


def glob_regex(glob: str) -> str:
    """An anchored regular expression for one glob: ``**``, ``*``, ``?`` and braces."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            close = glob.index("}", i)
            out += "(?:" + "|".join(map(re.escape, glob[i + 1:close].split(","))) + ")"
            i = close + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def ignore_regex(globs: Sequence[str], footprint: str) -> str:
    always = [f"**/{footprint}/**", "**/.git/**"]
    every = dict.fromkeys([*always, *globs])
    bare = [g[:-3] for g in every if g.endswith("/**")]
    return "^(?:" + "|".join(glob_regex(g) for g in dict.fromkeys([*every, *bare])) + r")\z"


def is_ignored(root: Column, path: Column, globs: Sequence[str], footprint: str) -> Column:
    pattern = ignore_regex(globs, footprint)
    base = F.regexp_replace(_normal(root), r"/+\z", "")
    p = _normal(path)
    rel = rel_path_of(root, path)
    return (
        F.when(p == base, False)
        .when(rel.isNull(), True)
        .otherwise(rel.rlike(pattern) | p.rlike(pattern))
    )


def is_footprint(path: Column, footprint: str) -> Column:
    """A path of the recorder itself, which a dirty list does not report."""
    return F.array_contains(F.split(forward_slashes(path), "/"), footprint)
