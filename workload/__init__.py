"""Queries over the driver's tables, one per operator, each with an independent SQL twin."""

from workload import experiments, features, learning, profiling, sources, texts

MODULES = (sources, profiling, features, learning, experiments, texts)


def all_checks():
    checks = {}
    for module in MODULES:
        for check in module.CHECKS:
            if check.name in checks:
                raise ValueError(f"two queries are named {check.name}")
            checks[check.name] = check
    return checks
