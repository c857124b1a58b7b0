"""Version control listings, on the driver; any failure of the tool gives None."""

from __future__ import annotations

import hashlib
import os
import subprocess


def _git(root: str, *args: str) -> bytes | None:
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout if run.returncode == 0 else None


def head_sha(root: str) -> str | None:
    out = _git(root, "rev-parse", "HEAD")
    return out.decode().strip() if out is not None else None


def _names(out: bytes) -> list[str]:
    return [p.decode("utf-8", "replace") for p in out.split(b"\0") if p]


def changed_paths(root: str, since: str, seeded: list[str] = ()) -> list[str] | None:
    """Paths that differ from commit ``since``: by commits, in the working tree, untracked, or ``seeded``
    ones that are gone."""
    committed = _git(root, "diff", "--name-only", "-z", since, "HEAD")
    working = _git(root, "diff", "--name-only", "-z", "HEAD")
    untracked = _git(root, "ls-files", "--others", "--exclude-standard", "-z")
    if committed is None or working is None or untracked is None:
        return None
    missing = [p for p in seeded if not os.path.exists(os.path.join(root, p))]
    return sorted({*missing, *_names(committed), *_names(working), *_names(untracked)})


def fingerprint(root: str) -> str | None:
    """A digest of HEAD, the changes of the working tree, and path, time and size of untracked files."""
    head, diff, untracked = _git(root, "rev-parse", "HEAD"), _git(root, "diff", "HEAD"), _git(root, "ls-files", "--others", "--exclude-standard", "-z")
    if head is None or diff is None or untracked is None:
        return None
    h = hashlib.sha256(head.strip() + b"\0" + diff)
    for p in sorted(_names(untracked)):
        try:
            st = os.stat(os.path.join(root, p))
        except OSError:
            continue
        h.update(f"\0{p}\0{st.st_mtime_ns}\0{st.st_size}".encode())
    return h.hexdigest()


def common_dir(root: str) -> str | None:
    out = _git(root, "rev-parse", "--path-format=absolute", "--git-common-dir")
    return os.path.realpath(out.decode().strip()) if out is not None else None


def worktree_ids(root: str) -> tuple[str, str] | None:
    """(repository, worktree): prefixes of digests; the primary worktree has the repository's."""
    shared = common_dir(root)
    own = _git(root, "rev-parse", "--path-format=absolute", "--git-dir")
    if shared is None or own is None:
        return None
    short = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    repo = short(shared)
    primary = os.path.realpath(own.decode().strip()) == shared
    return repo, repo if primary else f"{repo}-{short(os.path.realpath(root))}"
