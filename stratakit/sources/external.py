"""Inputs that come from outside the store: standard input, BAM files by way of samtools, archives by URL. Driver only."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
import tarfile
import tempfile
import urllib.request


def local_sam(source: str, target: str) -> str:
    """Path of SAM text: ``-`` is copied from standard input to ``target``, a BAM file unpacked there; others are as they are."""
    if source == "-":
        with open(target, "wb") as out:
            shutil.copyfileobj(sys.stdin.buffer, out)
        return target
    if source.endswith(".bam"):
        if shutil.which("samtools") is None:
            raise RuntimeError("BAM files need samtools on the path")
        with open(target, "wb") as out:
            subprocess.run(["samtools", "view", "-h", source], check=True, stdout=out)
        return target
    return source


def pull(url: str, folder: str) -> list[str]:
    """Names of the files of a tar archive that is fetched and unpacked into ``folder``."""
    os.makedirs(folder, exist_ok=True)
    with tempfile.TemporaryFile() as held:
        with urllib.request.urlopen(url) as source:
            shutil.copyfileobj(source, held)
        held.seek(0)
        with tarfile.open(fileobj=held) as tar:
            tar.extractall(folder, filter="data")
            return [m.name for m in tar.getmembers() if m.isfile()]
