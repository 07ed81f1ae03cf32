"""Study constants and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: gene panels, response names, thresholds, model parameters ----
DDR_GENES = (
    "BRCA1", "BRCA2", "ATM", "ATR", "PALB2", "RAD51", "MLH1", "MSH2", "MSH6",
    "POLE", "ARID1A", "CDK12", "CHEK2",
)
HR_GENES = ("BRCA1", "BRCA2", "PALB2", "RAD51", "ATM", "ATR")
MMR_GENES = ("MLH1", "MSH2", "MSH6")
HR_GENES_REQUESTED = (
    "BRCA1", "BRCA2", "PALB2", "RAD51", "RAD51B", "RAD51C", "RAD51D", "ATM", "BARD1",
    "BRIP1", "CHEK2", "FANCA", "FANCC", "FANCD2", "FANCE", "FANCF", "NBN", "MRE11A",
    "RAD50",
)
INTERACTION_PAIRS = (
    ("BRCA1", "BRCA2"), ("ATM", "ATR"), ("MLH1", "MSH2"), ("BRCA1", "PALB2"),
)
DDR_DRUGS = ("olaparib", "rucaparib", "talazoparib", "AZD6738", "VE-822")
DRUG_PLAN = {
    1017: "Olaparib",
    1175: "Rucaparib",
    1259: "Talazoparib",
    1030: "KU-55933",
    1022: "AZD7762",
}
C_VALUES = (0.01, 0.1, 1.0, 10.0)
METRICS = ("auc", "accuracy", "precision", "recall", "f1")
# ---- end of fixed values ----


@dataclass(frozen=True)
class BoostingParams:
    trees: int = 200
    depth: int = 4
    learning_rate: float = 0.1
    subsample: float = 0.8
    min_split: int = 10
    min_leaf: int = 5


@dataclass(frozen=True)
class StudyConfig:
    """Everything a screen needs besides its tables."""

    full_panel: tuple[str, ...] = DDR_GENES
    hr_panel: tuple[str, ...] = HR_GENES
    mmr_panel: tuple[str, ...] = MMR_GENES
    responses: tuple[str, ...] = DDR_DRUGS
    interaction_pairs: tuple[tuple[str, str], ...] = INTERACTION_PAIRS
    threshold: float = 0.0
    min_class: int = 15
    folds: int = 5
    inner_folds: int = 3
    seed: int = 42
    c_values: tuple[float, ...] = C_VALUES
    boosting: BoostingParams = field(default_factory=BoostingParams)

    def validate(self) -> None:
        """Raise ValueError on the first setting out of range."""
        for name, panel in (("hr_panel", self.hr_panel), ("mmr_panel", self.mmr_panel)):
            if not set(panel) <= set(self.full_panel):
                raise ValueError(f"{name} must be a subset of full_panel")
        if self.folds < 2:
            raise ValueError("folds must be at least 2")
        if self.seed < 0:
            raise ValueError("seed must not be negative")
        if not self.responses:
            raise ValueError("responses must not be empty")
