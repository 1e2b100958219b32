"""Foreign keys: a child key takes its parent key's masked value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CycleRefused, InvalidRule, NamespaceRequired, OrphansFound
from ..keys import hmac_hex, pick, row_message
from .joins import counted_join, lookup_join
from .masks import STRATEGIES, Context, Rule
from .ordering import with_row_index

POLICIES = ("preserve", "remap", "remap_to_existing", "warn", "fail")


@dataclass(frozen=True)
class Link:
    """parent(columns) <- child(columns). Several columns are one composite key, compared as a tuple."""

    parent: str
    parent_columns: tuple[str, ...]
    child: str
    child_columns: tuple[str, ...]
    orphans: str
    namespace: str | None = None

    def __post_init__(self):
        if self.orphans not in POLICIES:
            raise InvalidRule(f"unknown orphan policy {self.orphans!r}")
        if len(self.parent_columns) != len(self.child_columns):
            raise InvalidRule("a link needs as many child columns as parent columns")


def child_rules(link: Link, parent_rules: Sequence[Rule]) -> list[Rule]:
    """A value-keyed parent needs no join: the child runs the parent's own rule in the parent's namespace."""
    by_col = {c: r for r in parent_rules for c in r.columns}
    out = []
    for p, c in zip(link.parent_columns, link.child_columns):
        r = by_col[p]
        if not STRATEGIES[r.strategy].join_safe and r.strategy != "passthrough":
            raise InvalidRule(f"{link.parent}.{p}: a key needs a join-safe strategy or a key map")
        space = r.namespace or link.namespace
        if r.strategy != "passthrough" and space is None:
            raise NamespaceRequired(f"the parent key {link.parent}.{p} has no namespace")
        out.append(replace(r, columns=(c,), namespace=space))
    return out


def key_map(parent: DataFrame, masked: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(old key, new key) of any masked parent, matched over a row key both frames carry."""
    new = masked.select(*on, *[F.col(c).alias(f"__new_{c}") for c in columns if c not in on])
    return parent.select(*dict.fromkeys([*on, *columns])).join(new, list(on)).select(
        *columns, *[f"__new_{c}" for c in columns]).distinct()


def table_order(tables: Sequence[str], links: Sequence[Link]) -> list[str]:
    """Parents first. A self reference is fine, a circle of tables is refused."""
    left, out = list(tables), []
    while left:
        ready = [t for t in left if not any(
            k.child == t and k.parent != t and k.parent in left for k in links)]
        if not ready:
            raise CycleRefused(f"tables in a circle: {', '.join(sorted(left))}")
        out += ready
        left = [t for t in left if t not in ready]
    return out


def _complete(columns: Sequence[str]):
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return cond


def orphan_rows(parent: DataFrame, child: DataFrame, link: Link) -> DataFrame:
    """Children whose complete key has no parent; a key with any null part is not checked."""
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(link.parent_columns, link.child_columns)]).distinct()
    return lookup_join(child.where(_complete(link.child_columns)), keys, link.child_columns, "left_anti")


def orphan_keys(parent: DataFrame, child: DataFrame, link: Link) -> DataFrame:
    """(child columns, __n): the complete keys without a parent, each once, and how many children hold it."""
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(link.parent_columns, link.child_columns)]).distinct()
    return counted_join(child.select(*link.child_columns).where(_complete(link.child_columns)), keys, link.child_columns, "left_anti")


def orphan_count(parent: DataFrame, child: DataFrame, link: Link) -> int:
    return orphan_keys(parent, child, link).agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]


def propagate(child: DataFrame, keymap: DataFrame, link: Link, secret: bytes, warnings: list[str] | None = None,
              parent: DataFrame | None = None, parent_rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """Replace the child key through a key map (old parent columns, ``__new_`` columns) and the orphan policy.

    ``parent_rules`` (parent column -> its rule) says how ``remap`` masks an orphan; without it the parent is hashed."""
    old = dict(zip(link.parent_columns, link.child_columns))
    small = keymap.select(*[F.col(p).alias(c) for p, c in old.items()],
                          *[F.col(f"__new_{p}").alias(f"__new_{c}") for p, c in old.items()], F.lit(True).alias("__hit"))
    if link.orphans == "fail":
        if not counted_join(child.select(*link.child_columns).where(_complete(link.child_columns)), small.select(
                *link.child_columns), link.child_columns, "left_anti").isEmpty():
            raise OrphansFound(f"{link.child} has keys without a parent in {link.parent}")
    joined = lookup_join(child, small, link.child_columns)
    if link.orphans == "warn" and warnings is not None:
        n = joined.where(F.col("__hit").isNull() & _complete(link.child_columns)).count()
        if n:
            warnings.append(f"{link.child} -> {link.parent}: {n} orphan keys kept")
    if link.orphans == "remap_to_existing":
        joined = _remap_to_existing(joined, keymap, link, secret)
    exprs = {}
    ctx = Context(child.schema, secret, link.child, stage=False)
    for p, c in old.items():
        new = F.col(f"__new_{c}")
        if link.orphans == "remap":
            # masked the way the parent key is, in the link's namespace
            same = (parent_rules or {}).get(p) or Rule((p,), "hash", {}, link.namespace or f"{link.parent}.{p}")
            alt = STRATEGIES[same.strategy].apply(ctx, replace(same, columns=(c,)), F.col(c))
            exprs[c] = F.when(F.col("__hit"), new).otherwise(alt.cast(keymap.schema[f"__new_{p}"].dataType))
        elif link.orphans == "remap_to_existing":
            exprs[c] = F.coalesce(new, F.col(f"__alt_{c}"))
        else:
            exprs[c] = F.when(F.col("__hit"), new).otherwise(F.col(c).cast(keymap.schema[f"__new_{p}"].dataType))
    return joined.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in child.columns])


def _remap_to_existing(joined: DataFrame, keymap: DataFrame, link: Link, secret: bytes) -> DataFrame:
    """An orphan takes a real parent, picked by the keyed digest of its own key."""
    from ..keys import subkey
    news = [f"__new_{p}" for p in link.parent_columns]
    pool = with_row_index(keymap.select(*news).distinct(), news, "__i")
    n = pool.count()
    key = subkey(secret, "remap", link.namespace or link.parent)
    alt = pool.select("__i", *[F.col(f"__new_{p}").alias(f"__alt_{c}") for p, c in zip(link.parent_columns, link.child_columns)])
    msg = row_message(*[F.col(c) for c in link.child_columns])
    # only an orphan asks for a row of the pool; everyone else has no index and matches none
    want = F.when(F.col("__hit").isNull() & _complete(link.child_columns), pick(hmac_hex(key, msg), max(n, 1)))
    asked = joined.withColumn("__i", want)
    orphans = lookup_join(asked.where(F.col("__i").isNotNull()), alt, ["__i"])
    rest = asked.where(F.col("__i").isNull())
    for c in link.child_columns:
        rest = rest.withColumn(f"__alt_{c}", F.lit(None).cast(alt.schema[f"__alt_{c}"].dataType))
    return orphans.unionByName(rest).drop("__i")


def integrity_report(edges: Sequence[tuple[Link, DataFrame, DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """One row per edge: children checked and orphans before and after. Edges are few; counting is on Spark."""
    rows = []
    for link, src_parent, src_child, out_parent, out_child in edges:
        row = _edge(link, src_parent, src_child).select(
            F.lit(f"{link.parent}->{link.child}").alias("edge"), F.col("checked").alias("source_checked"), F.col("orphans").alias("source_orphans"))
        after = _edge(link, out_parent, out_child)
        rows.append(row.withColumn("output_checked", after.select("checked").scalar()).withColumn("output_orphans", after.select("orphans").scalar()))
    return reduce(lambda a, b: a.unionByName(b), rows)


def _edge(link: Link, parent: DataFrame, child: DataFrame) -> DataFrame:
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(link.parent_columns, link.child_columns)],
                         F.lit(1).alias("__hit")).distinct()
    checked = child.select(*link.child_columns).where(_complete(link.child_columns))
    hit = counted_join(checked, keys, link.child_columns)
    return hit.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("checked"), F.coalesce(F.sum(F.when(F.col("__hit").isNull(), F.col("__n"))), F.lit(0)).alias("orphans"))


def mask_linked(tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]], links: Sequence[Link], secret: bytes,
                row_keys: Mapping[str, Sequence[str]] | None = None, warnings: list[str] | None = None,
                unconfigured: str = "error", with_errors: bool = False) -> dict[str, DataFrame]:
    """Mask several tables, parents first.

    Under remap and fail a child key runs the parent key's own rule and needs no join. Under preserve and warn it
    must be known which keys have a parent, so the child looks its key up among the parent's distinct keys.
    """
    from .masks import keep, mask_table
    order = table_order(list(tables), links)
    resolved = {t: list(r) for t, r in rules.items()}
    looked_up: dict[str, list[Link]] = {t: [] for t in tables}

    def key_frame(link: Link) -> DataFrame:
        """(old key, __new_ key) of the parent's distinct keys, masked as the parent table masks them."""
        cols = link.parent_columns
        base = tables[link.parent].select(*cols).distinct()
        frame = base.select(*cols, *[F.col(c).alias(f"__new_{c}") for c in cols])
        inner = [k for k in looked_up[link.parent] if set(k.child_columns) & set(cols)]
        late = {c for k in inner for c in k.child_columns}
        own = [c for c in cols if c not in late]
        ruled = child_rules(Link(link.parent, tuple(own), link.child, tuple(f"__new_{c}" for c in own), link.orphans, link.namespace), resolved[link.parent])
        frame = mask_table(frame, [*ruled, *keep(*cols, *[f"__new_{c}" for c in cols if c in late])], secret, link.parent)
        for k in inner:
            if not set(k.child_columns) <= set(cols):
                raise InvalidRule(f"{link.child} -> {link.parent}: the link takes part of a composite key")
            frame = propagate(frame, key_frame(k), replace(k, child=link.parent, child_columns=tuple(f"__new_{c}" for c in k.child_columns),
                                                           orphans="preserve" if k.orphans == "warn" else k.orphans), secret)
        return frame

    done: dict[str, DataFrame] = {}
    for name in order:
        for link in (k for k in links if k.child == name):
            if link.orphans == "fail" and not orphan_keys(tables[link.parent], tables[name], link).isEmpty():
                raise OrphansFound(f"{name} has keys without a parent in {link.parent}")
            resolved[name] = [r for r in resolved[name] if r.column not in link.child_columns]
            chained = any(set(k.child_columns) & set(link.parent_columns) for k in looked_up[link.parent])
            if link.orphans in ("remap", "fail") and not chained:
                resolved[name] += child_rules(link, resolved[link.parent])
            else:
                looked_up[name].append(link)
                resolved[name] += keep(*link.child_columns)
        out = mask_table(tables[name], resolved[name], secret, name, (row_keys or {}).get(name, ()), unconfigured, with_errors)
        for link in looked_up[name]:
            # a key that is itself looked up stays in its table; its orphans are hashed
            own = {r.column: r for r in resolved[link.parent] if len(r.columns) == 1 and r.strategy != "passthrough"}
            out = propagate(out, key_frame(link), replace(link, orphans="preserve") if link.orphans == "fail" else link, secret, warnings, parent_rules=own)
        done[name] = out
    return done
