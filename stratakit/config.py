"""Settings of a profile run, with the checks and defaults that depend on one another."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from stratakit.operators.rollup import Cutoffs
from stratakit.sources.tables import MAJOR_RANKS


@dataclass(frozen=True)
class ProfileConfig:
    database: str
    sam: str | None = None
    reads: tuple[str, ...] = ()
    db_level: str | None = None
    prefix: str | None = None
    preset: str = "sr"
    aligner_options: str = "auto"
    remove_multiple: str = "auto"
    match_factor: float = 0.0
    cutoffs: Cutoffs = field(default_factory=Cutoffs)
    abundance: str = "depth"
    fmt: str = "tsv"
    no_cutoffs: bool = False
    threads: int = 1

    def resolved(self) -> ProfileConfig:
        """Defaults filled in; raises ValueError on settings that do not go together."""
        if bool(self.sam) == bool(self.reads):
            raise ValueError("give either reads or a SAM file")
        if self.abundance not in ("depth", "read_count", "genomic_content_est"):
            raise ValueError(f"no such abundance: {self.abundance}")
        if self.fmt not in ("tsv", "csv", "biom"):
            raise ValueError(f"no such format: {self.fmt}")
        database = re.sub(r"\.mmi$", "", self.database)
        level = self.db_level or next((p for p in reversed(database.split(".")) if p in MAJOR_RANKS), None)
        if level is None:
            raise ValueError("the database's level is not in its name; give db_level")
        name = (self.reads[0] if self.reads else self.sam).rsplit("/", 1)[-1]
        prefix = self.prefix or ("stdin" if name == "-" else re.sub(r"(\.(sam|bam|fastq|fq|fasta|fa|gz))+$", "", name))
        remove = {"auto": "yes" if self.reads else "no"}.get(self.remove_multiple, self.remove_multiple)
        options = ("-s60" if self.preset == "sr" else "") if self.aligner_options == "auto" else self.aligner_options
        cut, factor = self.cutoffs, self.match_factor
        if self.preset in ("map-ont", "ont"):
            cut, factor = replace(cut, min_reads=1, max_zscore=0.0), 0.0
        if self.no_cutoffs:
            cut, factor = Cutoffs(0.0, 0, 0, 0.0, 0.0, 0.0), 0.0
        return replace(self, database=database, db_level=level, prefix=prefix, remove_multiple=remove, aligner_options=options, cutoffs=cut, match_factor=factor)


def ani_limits(text: str) -> tuple[float, float]:
    """``species,strain`` limits; a single value leaves the strain limit at 0.99."""
    parts = [*text.split(","), "0.99"]
    return float(parts[0]), float(parts[1])
