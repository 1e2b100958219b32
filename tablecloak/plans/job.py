"""A whole run: shape, subset, mask and generate, check, quarantine, publish. It only composes the operators; each
output is one Spark plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRule, PolicyFailed
from ..operators import evidence
from ..operators.checks import TRIGGERS, Check, failures, quarantine, write_quarantine
from ..operators.generate import Generator, GenTable, Source
from ..operators.masks import Rule, check_declared
from ..operators.relations import Link, mask_linked
from ..operators.scan import drift_gate, scan
from ..operators.shape import Step, shape
from ..operators.subset import SubsetPlan, subset
from ..operators.vault import save_sealed, seal
from ..session import materialize
from ..sources.writers import publish_outputs


@dataclass(frozen=True)
class MaskTable:
    source: DataFrame
    rules: Sequence[Rule]
    steps: Sequence[Step] = ()
    row_key: Sequence[str] = ()


@dataclass(frozen=True)
class Job:
    """``masks`` and ``generates`` may be mixed. A generated table may reference a masked output by name."""

    secret: bytes | None = None
    seed: int = 42
    masks: Mapping[str, MaskTable] = field(default_factory=dict)
    generates: Sequence[GenTable] = ()
    links: Sequence[Link] = ()
    subset: SubsetPlan | None = None
    expects: Mapping[str, Sequence[Check]] = field(default_factory=dict)
    quarantine_path: str | None = None
    vault_path: str | None = None
    triggers: Sequence[str] = TRIGGERS
    baseline: Mapping[str, DataFrame] = field(default_factory=dict)
    on_drift: str = "refuse"
    targets: Mapping[str, str] = field(default_factory=dict)
    delivery: str = "strict"
    unconfigured: str = "error"


@dataclass
class JobResult:
    outputs: dict[str, DataFrame]
    quarantined: dict[str, DataFrame]
    warnings: list[str]
    evidence: DataFrame | None
    published: dict[str, str]


def validate(job: Job) -> list[str]:
    """Config and schema checks only; no Spark job runs. Returns warnings."""
    names = [*job.masks, *[t.name for t in job.generates]]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise InvalidRule(f"tables declared twice: {', '.join(twice)}")
    if job.masks and job.secret is None:
        raise InvalidRule("masking needs a mask secret; the seed is no key")
    notes = []
    for name, t in job.masks.items():
        keys = {c for k in job.links if k.child == name for c in k.child_columns}
        shaped = shape(t.source, t.steps)
        rules = [r for r in t.rules if r.column not in keys]
        notes += check_declared(shaped.drop(*keys), rules, name, job.unconfigured)
    return notes


def _pairs(masked: DataFrame, rules: Sequence[Rule], table: str) -> DataFrame:
    cells = [F.struct(F.lit(r.namespace or f"{table}.{c}").alias("ns"), F.col(c).cast("string").alias("token"),
                      F.col(f"__row.{c}").cast("string").alias("value")) for r in rules for c in r.columns]
    return masked.select(F.explode(F.array(*cells)).alias("p")).select("p.*")


def run(spark: SparkSession, job: Job) -> JobResult:
    warnings = validate(job)
    shaped = {n: shape(t.source, t.steps) for n, t in job.masks.items()}
    for name, base in job.baseline.items():
        warnings += drift_gate(base, scan(shaped[name], name), job.on_drift)
    if job.subset is not None:
        shaped = subset(shaped, job.subset)
    vaulted = {n: [r for r in t.rules if r.vault] for n, t in job.masks.items()}
    if any(vaulted.values()) and not job.vault_path:
        raise InvalidRule("vaulted columns need a vault_path")
    # source rows travel with masked ones where they are needed again
    split = bool(job.quarantine_path) or any(vaulted.values())
    masked = mask_linked(shaped, {n: t.rules for n, t in job.masks.items()}, job.links, job.secret, {n: t.row_key for n, t in job.masks.items()},
                         warnings, job.unconfigured, with_errors=split) if job.masks else {}
    outputs, bad = {}, {}
    for name, df in masked.items():
        if split:
            # read twice, as clean rows and as failed ones, so masked once
            both = materialize(df, f"masked-{name}")
            if vaulted[name]:
                save_sealed(seal(_pairs(both, vaulted[name], name), job.secret), f"{job.vault_path.rstrip('/')}/{name}")
            if job.quarantine_path:
                outputs[name], bad[name] = quarantine(both, job.expects.get(name, ()), job.triggers)
            else:
                outputs[name] = both.drop("__errors", "__row")
        else:
            outputs[name] = df
            if job.expects.get(name):
                failed = [r["check"] for r in failures(df, job.expects[name]).where("failed > 0").collect()]
                if failed:
                    raise PolicyFailed(f"{name}: {', '.join(failed)}")
    if job.generates:
        wanted = {g.options["reference_table"] for t in job.generates for g in t.columns if g.type in ("reference", "lookup")}
        sources = {n: Source(outputs[n], outputs[n].columns) for n in wanted if n in outputs}
        outputs.update(Generator(spark, job.generates, sources, job.seed).run())
    for name, df in bad.items():
        write_quarantine(df, f"{job.quarantine_path.rstrip('/')}/{name}")
    published = publish_outputs(spark, {n: outputs[n] for n in job.targets}, job.targets, job.delivery) if job.targets else {}
    final = {n: spark.read.parquet(job.targets[n]) if published.get(n) == "published" else df for n, df in outputs.items()}
    proof = evidence.manifest(shaped, final, {n: t.rules for n, t in job.masks.items()}) if shaped or final else None
    return JobResult(final, bad, warnings, proof, published)
