"""Identity of an experiment: a hash of its frozen spec and of three snapshots of what it read."""

from __future__ import annotations

import hashlib

from tessaro.sources.catalog import Dataset, canonical_json

# Names that must be resolved before there is an identity, and the tables of each snapshot.
FLOATING = ("CURRENT", "CURRENT_ACCEPTED")
PINNED = ("dataset_version", "universe_version", "data_acceptance_id")
EXPERIMENT_TABLES = ("corporate_action", "corporate_action_coverage")
ENVIRONMENT_TABLES = ("daily_bar", "adjusted_bar", "trading_calendar")
SCHEME = 2


class NotFrozen(ValueError):
    """A spec that names a floating version has no identity."""


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def snapshots(version: Dataset, strategy: dict, policies: dict) -> dict[str, dict]:
    """Three payloads: the strategy's own parameters; corporate actions and policies; price tables and calendar. Tables enter by
    the content hashes of the version's manifest, so no row is read."""
    of = lambda names: {t: version.manifest["tables"].get(t) for t in names}
    return {"strategy": strategy, "experiment": {"tables": of(EXPERIMENT_TABLES), "policies": policies}, "data_environment": of(ENVIRONMENT_TABLES)}


def experiment_id(spec: dict, bundle: dict[str, dict]) -> str:
    """The same for equal content, whatever the order of keys."""
    if floating := [k for k in PINNED if spec.get(k) is None or spec[k] in FLOATING]:
        raise NotFrozen(f"not resolved: {', '.join(floating)}")
    return digest({"scheme": SCHEME, "spec": spec, "snapshots": bundle, "hashes": {k: digest(v) for k, v in bundle.items()}})
