"""Data masking, synthesis and privacy checks on Spark: frames in, frames out."""

from .operators.generate import Generator, GenTable, Source, gen
from .operators.masks import Rule, keep, rule
from .operators.masks import mask_table as mask
from .operators.scan import scan
from .operators.subset import Seed, SubsetPlan, subset
from .session import build_session

__all__ = ["GenTable", "Generator", "Rule", "Seed", "Source", "SubsetPlan", "build_session", "gen", "keep", "mask", "rule", "scan", "subset"]
