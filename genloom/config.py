"""Parameters of the genome flows, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """Fixed default values, by stage."""

    keep_pseudo: bool = True
    peptide_score: float = 0.90  # strictly above
    orf_min_aa: int = 5
    orf_max_aa: int = 100
    gene_overlap_nt: int = 20
    max_proteins: int = 200_000
    min_coverage: float = 0.75
    mutual_min_pident: float = 60.0  # strictly above
    propagate_true_pairs: bool = True
    cutoff_std_factor: float = 3.0
    min_group_genomes: int = 5
    min_group_tuples: int = 10
    min_group_cutoff: float = 50.0
    group_tries: int = 5
    overlap_fraction: float = 0.5
    run_gap: int = 750
    island_gap: int = 750
    gene_gap: int = 50
    island_score_gap: float = 0.1
    lone_std: float = 0.05
    merge_gap: int = 50
    flank_genes: int = 5
    min_core_genes: int = 3
    max_avg_cog: float = 0.25
    min_family: int = 2
    seed_max_evalue: float = 1.0
    seed_min_bitscore: float = 30.0
    jaccard: float = 0.5
    common_share: float = 0.5
    inflation: float = 1.5
    bonus_transporter: float = 5.0
    bonus_peptidase: float = 3.0
    bonus_regulator: float = 3.0
    bonus_biosyn: float = 0.0

    def with_text(self, settings: dict[str, str]) -> EngineConfig:
        """Settings as text (keys in any case) over these values, each read as the type of its default."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        read = {}
        for key, text in settings.items():
            name = key.lower()
            if name not in kinds:
                raise KeyError(f"unknown setting {key}")
            read[name] = text.strip().lower() in ("1", "true", "yes", "on") if kinds[name] is bool else kinds[name](text)
        return replace(self, **read)


def coerce(text: str) -> int | float | bool | list | str:
    """A setting's text as the first type that fits: int, float, bool, comma list, string."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    if text.strip().lower() in ("true", "false"):
        return text.strip().lower() == "true"
    return [coerce(x.strip()) for x in text.split(",")] if "," in text else text
