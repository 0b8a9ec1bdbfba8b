"""Where model files live on disk: names, cache layout, completeness.  Nothing here uses a network."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from pathlib import Path

REQUIRED = ("config.json", "model.safetensors", "tokenizer.json")
#: variant to the folder of its files in a snapshot
VARIANTS = {"bf16": "", "q4-8emb": "q4-8emb"}


def repo_folder(repo: str) -> str:
    return "models--" + repo.replace("/", "--")


def cache_base(override: str | None = None, env: Mapping[str, str] | None = None) -> str:
    """The override, else HF_HUB_CACHE, else HF_HOME/hub, else the default; empty values do not count."""
    env = os.environ if env is None else env
    home = env.get("HF_HOME")
    found = override or env.get("HF_HUB_CACHE") or (f"{home}/hub" if home else None) or "~/.cache/huggingface/hub"
    return os.path.expanduser(found)


def variant_files(variant: str, include: Sequence[str] = ()) -> list[str]:
    """Files of a variant, those that hold one of the substrings; an unknown variant or none left raises."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}, expected one of {', '.join(VARIANTS)}")
    files = [os.path.join(VARIANTS[variant], f) for f in REQUIRED]
    files = [f for f in files if not include or any(part in f for part in include)]
    if not files:
        raise ValueError(f"no file of {variant!r} matches {list(include)}")
    return files


def plain_etag(raw: str) -> str:
    """Without a weak mark and the quotes around it."""
    s = raw.strip(" \t").removeprefix("W/")
    return s[1:-1] if len(s) >= 2 and s[0] == s[-1] == '"' else s


def link_target(path: str, etag: str) -> str:
    """Relative link from a snapshot's file to its blob."""
    return "../" * (1 + len([p for p in path.split("/") if p])) + "blobs/" + etag


def download_plan(repo: str, commit: str, variant: str, etags: Mapping[str, str], include: Sequence[str] = ()) -> list[dict[str, str]]:
    """What a fetcher has to lay out: for each file its blob, the unfinished name, the link and its target."""
    plan = []
    for path in variant_files(variant, include):
        etag = plain_etag(etags[path])
        blob = f"{repo_folder(repo)}/blobs/{etag}"
        plan.append({"file": path, "blob": blob, "unfinished": f"{blob}.incomplete", "link": f"{repo_folder(repo)}/snapshots/{commit}/{path}", "target": link_target(path, etag)})
    return plan


def cached_model(repo: str, variant: str, base: str | None = None) -> str | None:
    """Folder of a cached variant if its snapshot is complete and no link dangles."""
    root = Path(cache_base(base)) / repo_folder(repo)
    try:
        commit = (root / "refs" / "main").read_text().strip()
    except OSError:
        return None
    folder = root / "snapshots" / commit / VARIANTS.get(variant, variant)
    return str(folder) if commit and folder.is_dir() and all((folder / f).exists() for f in REQUIRED) else None


def model_folder(flag: str | None, repo: str, variant: str = "q4-8emb", base: str | None = None) -> str:
    """An explicit folder wins; else the cached variant; else an error before any input is read."""
    found = flag or cached_model(repo, variant, base)
    if not found:
        raise FileNotFoundError(f"no complete {variant} model in the cache")
    return found
