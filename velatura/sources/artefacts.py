"""Files of a run on any file system: find an earlier mask, move or delete what belongs to it."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from velatura.session import list_files, path_of

# What the artefacts of one mask begin with
PREFIXES = ("original", "anonimizado", "mascara")
_STAMP = re.compile(r"^\d{8}_\d{6}_")


def stem(name: str) -> str:
    """A file name without its time stamp and suffixes."""
    return re.sub(r"(\.meta|\.fp|\.fn)?\.[A-Za-z_]+$", "", _STAMP.sub("", name))


def find_mask(spark: SparkSession, folders: list[str], session: str, model: str) -> str | None:
    """The newest mask of a session and model in the first folder that has one, whatever its time stamp."""
    want = re.compile(rf"^(?:\d{{8}}_\d{{6}}_)?mascara_{re.escape(session)}_{re.escape(model)}\.txt$")
    for folder in folders:
        found = [n for n in list_files(spark, folder) if want.match(n)]
        if found:
            return f"{folder}/{found[-1]}"
    return None


def belonging(spark: SparkSession, mask: str) -> list[str]:
    """All files beside a mask that share its session and model."""
    folder, _, name = mask.rpartition("/")
    rest = stem(name).removeprefix("mascara_")
    return [f"{folder}/{n}" for n in list_files(spark, folder) if any(stem(n) == f"{p}_{rest}" for p in PREFIXES)]


def move(spark: SparkSession, mask: str, folder: str) -> list[str]:
    """Move a mask's files to a folder, which is made if it is missing; their new names."""
    fs, to = path_of(spark, folder)
    fs.mkdirs(to)
    out = []
    for f in belonging(spark, mask):
        target = f"{folder}/{f.rpartition('/')[2]}"
        if not fs.rename(path_of(spark, f)[1], path_of(spark, target)[1]):
            raise OSError(f"{f} couldn't be moved to {target}")
        out.append(target)
    return out


def delete(spark: SparkSession, mask: str) -> int:
    """Delete a mask's files; how many there were."""
    files = belonging(spark, mask)
    for f in files:
        fs, p = path_of(spark, f)
        fs.delete(p, False)
    return len(files)
