"""Releases in a store: load and flip, retention, and a purge that can't touch what is live.

The registry (source_version_id, source_db, version, digest) and the pointers
(source_db, current_source_version_id) are tables of the store like the data, which
has a folder for each release. So a load makes its rows, its registry row and its
pointer visible in one commit, and a purge drops folders without reading rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import versions
from helixframe.operators.store import Store, Transaction

REGISTRY, POINTERS, ID = "registry", "pointers", "source_version_id"


class Ambiguous(RuntimeError):
    """A source has several pointers."""


class Dangling(RuntimeError):
    """A pointer names a release that its source's registry doesn't have."""


class AtRisk(RuntimeError):
    """The live release is among those to be deleted."""


class StillReferenced(RuntimeError):
    """A table still has rows of a release whose registry row is to go."""


class Drift(RuntimeError):
    """What is live isn't what it was before the purge."""


def load(store: Store, source_db: str, version: str, digest: str, tables: Mapping[str, DataFrame]) -> dict:
    """Loads a release of a source under a fresh id and makes it live, in one commit; nothing if the live one has its label and digest.

    Returns skipped, source_version_id, prior_rows and new_rows.
    """
    change = store.begin()
    registry, pointers = change.read(REGISTRY), change.read(POINTERS)
    live = versions.live_id(pointers, source_db)
    row = registry.filter((F.col(ID) == live) & (F.col("source_db") == source_db)).first() if live is not None else None
    if row and versions.unchanged(row.version, row.digest, version, digest):
        return {"skipped": True, ID: live, "prior_rows": None, "new_rows": None}
    registered, fresh = versions.register(registry.drop("digest"), source_db, version)
    new = registered.filter(F.col(ID) == fresh).withColumn("digest", F.lit(digest))
    change.append(REGISTRY, registry.limit(0).unionByName(new, allowMissingColumns=True))
    prior, loaded = 0, 0
    for name, rows in tables.items():
        if live is not None and name in change.tables:
            prior += change.read(name).filter(F.col(ID) == live).count()
        change.append(name, rows.withColumn(ID, F.lit(fresh).cast("long")), ID)
        loaded += change.read(name).filter(F.col(ID) == fresh).count()
    change.replace(POINTERS, versions.flip(pointers, source_db, fresh).select(*pointers.columns))
    change.commit(loaded=fresh)
    return {"skipped": False, ID: fresh, "prior_rows": prior, "new_rows": loaded}


@dataclass
class Plan:
    """Of a source: its live release (None: no pointer, so all is kept), the newest other one, those to delete, and rows by release."""

    source_db: str
    active: int | None
    prior: int | None
    deletable: list[int]
    rows: dict[int, int]


@dataclass
class Result:
    plans: list[Plan]
    executed: bool = False
    orphans: list[int] = field(default_factory=list)
    data_rows: int = 0
    registry_rows: int = 0


def _counts(state: Transaction, tables: Sequence[str]) -> dict[int, int]:
    """Rows of each release in some tables; one row for each release comes to the driver, as many as the registry has."""
    known = [t for t in tables if t in state.tables]
    return {r[ID]: r.n_rows for r in versions.row_counts({t: state.read(t) for t in known}).collect()} if known else {}


def plan(state: Transaction, owned: Mapping[str, Sequence[str]], keep: int = 1) -> list[Plan]:
    """What a purge would delete of each source: releases with rows that are not live, but for the newest `keep`.

    The live release is the one that the pointer names, never the newest. A source
    without a pointer keeps all.
    """
    pointers: dict[str, list[int]] = {}
    for r in state.read(POINTERS).collect():
        pointers.setdefault(r.source_db, []).append(r.current_source_version_id)
    known = {(r.source_db, r[ID]) for r in state.read(REGISTRY).select("source_db", ID).collect()}
    out = []
    for source, tables in sorted(owned.items()):
        ids = {i for s, i in known if s == source}
        rows = {i: n for i, n in _counts(state, tables).items() if i in ids}
        named = pointers.get(source, [])
        if len(named) > 1:
            raise Ambiguous(f"{source} has {len(named)} pointers")
        if not named:
            out.append(Plan(source, None, None, [], rows))
            continue
        if (source, named[0]) not in known:
            raise Dangling(f"the pointer of {source} names {named[0]}, which is not registered for it")
        others = sorted((i for i in rows if i != named[0]), reverse=True)
        out.append(Plan(source, named[0], others[0] if others else None, sorted(others[max(keep, 0) :]), rows))
    return out


def _guard(plans: Sequence[Plan]) -> None:
    for p in plans:
        if p.active in p.deletable:
            raise AtRisk(f"{p.source_db}: the live release {p.active} is to be deleted")


def _referenced(state: Transaction, children: Mapping[str, str], ids: Sequence[int]) -> dict[int, str]:
    """Of some releases those that a child table still names, each in its own column, and one such table."""
    out: dict[int, str] = {}
    for table, column in children.items():
        if table in state.tables and ids:
            for r in state.read(table).filter(F.col(column).isin(list(ids))).select(column).distinct().collect():
                out.setdefault(r[0], table)
    return out


def _unregister(store: Store, ids: Sequence[int], what: str) -> int:
    if not ids:
        return 0
    change = store.begin()
    change.replace(REGISTRY, change.read(REGISTRY).filter(~F.col(ID).isin(list(ids))))
    change.commit(**{what: list(ids)})
    return len(ids)


def purge(store: Store, owned: Mapping[str, Sequence[str]], children: Mapping[str, str], keep: int = 1, execute: bool = False) -> Result:
    """Deletes superseded releases: the data in one commit, the registry rows in a second, and then registry rows that nothing has.

    owned lists the data tables of each source, children every table that names a
    release, with its column. Without execute it is a plan. Before the second
    commit no child may name a release that goes. The sweep takes registered
    releases of sources with a pointer that are not live, have no rows and no child,
    so also what a crash between the commits has left. At the end the pointers, the
    live registry rows and their row counts must be what they were.
    """
    before = store.begin()
    found = Result(plan(before, owned, keep))
    _guard(found.plans)
    pointers = sorted(map(tuple, before.read(POINTERS).collect()))
    doomed = [i for p in found.plans for i in p.deletable]
    found.orphans = _orphans(before, found.plans, children)
    if not execute:
        return found
    if doomed:
        change = store.begin()
        if change.base != before.base:
            raise Drift("the store has changed since the plan was made")
        for p in found.plans:
            for table in owned[p.source_db]:
                if table in change.tables:
                    change.drop(table, [i for i in p.deletable if i != p.active])
            found.data_rows += sum(p.rows[i] for i in p.deletable)
        change.commit(purged=doomed)
        if held := _referenced(store.begin(), children, doomed):
            raise StillReferenced(f"releases are still named: {held}")
        found.registry_rows = _unregister(store, doomed, "unregistered")
    after = store.begin()
    found.orphans = _orphans(after, plan(after, owned, keep), children)
    _unregister(store, found.orphans, "swept")
    now = store.begin()
    live = {p.source_db: (p.active, p.rows.get(p.active, 0)) for p in found.plans}
    if sorted(map(tuple, now.read(POINTERS).collect())) != pointers or {p.source_db: (p.active, p.rows.get(p.active, 0)) for p in plan(now, owned, keep)} != live:
        raise Drift("what is live changed during the purge")
    found.executed = True
    return found


def _orphans(state: Transaction, plans: Sequence[Plan], children: Mapping[str, str]) -> list[int]:
    sources = {p.source_db: p for p in plans if p.active is not None}
    loose = [r[ID] for r in state.read(REGISTRY).select("source_db", ID).collect() if r.source_db in sources and r[ID] != sources[r.source_db].active and not sources[r.source_db].rows.get(r[ID])]
    held = _referenced(state, children, loose)
    return sorted(i for i in loose if i not in held)
