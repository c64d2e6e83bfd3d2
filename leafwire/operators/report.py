"""Results for people and files: the payload of an evaluation, its summary, a model card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwire.functions import native
from leafwire.operators import evaluate
from leafwire.sources.jsonl import write_document


def payload(pairs: DataFrame, stack: str = "spark", per_group: int | None = None, seed: int = 0, stage: str | None = None) -> dict:
    """Scores of all groups and the gate, as one document. Only sums come to the driver."""
    scores = evaluate.groups(evaluate.scored(pairs)).cache()
    try:
        found = {r["grp"]: {k: r[k] for k in ("parse", "fidelity", "repaired", "n", "skipped")} for r in scores.orderBy("grp").collect()}
        verdict = evaluate.gate(scores, stage) if stage else None
    finally:
        scores.unpersist()
    return {"stack": stack, "n_per_group": per_group, "seed": seed, "groups": found, "gate": verdict}


def exit_code(document: dict) -> int:
    """1 only where a gate was asked for and has failed."""
    return int(bool(document["gate"]) and document["gate"]["passed"] is False)


def percent(part: int, whole: int) -> str:
    return f"{round(100 * part / whole)}%" if whole else "n/a"


def summary(document: dict) -> str:
    lines = [f"{name}: parse {g['parse']}/{g['n']} ({percent(g['parse'], g['n'])}), fidelity {g['fidelity']}/{g['n']} ({percent(g['fidelity'], g['n'])}), repaired {g['repaired']}, skipped {g['skipped']}" for name, g in document["groups"].items()]
    if gate := document["gate"]:
        verdict = {True: "PASS", False: "FAIL", None: "no checks"}[gate["passed"]]
        lines.append(f"gate {gate['stage']}: {verdict}")
        lines += [f"  {c['metric']} {c['actual']} (at least {c['threshold']}): {'ok' if c['ok'] else 'failed'}" for c in gate["checks"]]
    return "\n".join(lines)


def model_card(document: dict, base_model: str, run: dict | None = None, tokens: dict[str, float] | None = None) -> str:
    """Markdown of an evaluation and its run; groups without rows are left out.

    ``run``: facts of the run (see :func:`run_record`), of which ``final_loss``, ``data`` and ``hyperparameters`` are
    shown; ``tokens``: the token ratio of each group.
    """
    run = run or {}
    license_id, license_name, link, attribution = native.LICENSES["qwen" if "qwen" in base_model.lower() else "llama"]
    rows = [f"| {name} | {percent(g['parse'], g['n'])} | {percent(g['fidelity'], g['n'])} | {g['n']} |" for name, g in document["groups"].items() if g["n"]]
    loss = run.get("final_loss")
    parts = [
        f"---\nlicense: {license_id}\nbase_model: {base_model}\n---",
        "| group | parse | fidelity | n |\n|---|---|---|---|\n" + "\n".join(rows),
        f"Final loss: {f'{loss:.4g}' if isinstance(loss, int | float) else '—'}",
    ]
    if tokens:
        parts.append("## Tokens against JSON\n\n" + "\n".join(f"* {name}: {ratio:.2f}" for name, ratio in tokens.items()))
    for title, facts in (("Data", run.get("data")), ("Hyperparameters", run.get("hyperparameters"))):
        if facts:
            parts.append(f"## {title}\n\n" + "\n".join(f"* {k}: {v}" for k, v in facts.items()))
    parts.append(f"## License\n\n{license_name} ({link}). {attribution}.")
    return "\n\n".join(parts) + "\n"


def write_results(pairs: DataFrame, path: str, **options) -> dict:
    document = payload(pairs, **options)
    write_document(pairs.sparkSession, path, document)
    return document


def run_record(log: DataFrame, **facts) -> dict:
    """Facts of a run with the last losses of its step log."""
    columns = [c for c in ("loss", "eval_loss") if c in log.columns]
    last = log.agg(*[F.expr(f"max_by({c}, step) filter (where {c} is not null)").alias(c) for c in columns], F.max("step").alias("steps")).first()
    return {**facts, "steps": last["steps"], "final_loss": last["loss"] if "loss" in columns else None, "final_eval_loss": last["eval_loss"] if "eval_loss" in columns else None}
