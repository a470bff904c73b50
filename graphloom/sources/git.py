"""What git knows: visible files, changes by name and status, diffs."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Arguments of git diff by mode.
MODES = {"unstaged": [], "staged": ["--cached"], "all": ["HEAD"]}


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, "-c", "core.quotepath=off", *args], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode(errors="replace")


def visible_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files that git sees in a work tree: tracked ones, and untracked ones that no .gitignore names; removed ones are left out."""
    listed = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0")
    gone = set(_git(root, "ls-files", "-z", "--deleted").split("\0"))
    return spark.createDataFrame([(p,) for p in sorted(set(listed) - gone) if p], "path string")


def parse_name_status(entries: DataFrame) -> DataFrame:
    """(status, old_path, new_path, change_kind) of name-status entries (entry: tab-separated). Copies count as renames, added files have no old path, deleted ones no new path."""
    part = F.split("entry", "\t")
    status, first, second = part[0], F.get(part, F.lit(1)), F.get(part, F.lit(2))
    letter = F.substring(status, 1, 1)
    moved = letter.isin("R", "C")
    kind = F.when(moved, "renamed").when(letter == "A", "added").when(letter == "D", "deleted").when(letter == "M", "modified").otherwise("unknown")
    return entries.select(status.alias("status"), F.when(letter != "A", first).alias("old_path"), F.when(moved, F.coalesce(second, first)).when(letter != "D", first).alias("new_path"), kind.alias("change_kind"))


def changed_files(spark: SparkSession, root: str, mode: str = "unstaged", base: str | None = None) -> DataFrame:
    """parse_name_status of a work tree: unstaged, staged or all changes, or those since `base`; all also has untracked files."""
    tokens = _git(root, "diff", "--name-status", "-z", "-M", *([base] if base else MODES[mode])).split("\0")
    entries, k = [], 0
    while k < len(tokens) and tokens[k]:
        n = 3 if tokens[k][0] in "RC" else 2
        entries.append("\t".join(tokens[k : k + n]))
        k += n
    out = parse_name_status(spark.createDataFrame([(e,) for e in entries], "entry string"))
    if mode == "all" and not base:
        new = [p for p in _git(root, "ls-files", "-z", "--others", "--exclude-standard").split("\0") if p]
        out = out.unionByName(spark.createDataFrame([("?", None, p, "untracked") for p in sorted(new)], out.schema))
    return out


def diff_lines(spark: SparkSession, root: str, mode: str = "unstaged", base: str | None = None) -> DataFrame:
    """(diff_id, line_no, line) of a diff without context lines, for changes.parse_unified_diff."""
    text = _git(root, "diff", "--unified=0", "-M", "--no-color", *([base] if base else MODES[mode]))
    return spark.createDataFrame([(0, k, line) for k, line in enumerate(text.split("\n"))], "diff_id int, line_no int, line string")
