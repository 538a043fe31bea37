"""The failure taxonomy: 45 codes by lifecycle stage and root-cause pillar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code, name and pillar, in canonical order; the stage is the code's letter.
CODES = [
    ("A.1", "Frame-Lock & Tunnel Vision", "P2"),
    ("A.2", "Unfalsifiable Hypothesis", "P3"),
    ("A.3", "Redundant Discovery", "P2"),
    ("A.4", "Feasibility Misjudgement", "P4"),
    ("A.5", "Metric Misalignment", "P3"),
    ("A.6", "Hypothesis-Experiment Mismatch", "P1"),
    ("B.1", "Hallucinated Evidence & Unchecked Provenance", "P1"),
    ("B.2", "Retrieval-to-Action Gap", "P1"),
    ("B.3", "Unvetted Data Quality & Units", "P4"),
    ("B.4", "Shallow Search & Coverage Gaps", "P2"),
    ("B.5", "Citation Decorrelation", "P1"),
    ("B.6", "Low Signal-to-Noise Prioritization", "P2"),
    ("C.1", "Circular Validation & Shortcut Reliance", "P3"),
    ("C.2", "Grader-Fitting & Data Leakage", "P3"),
    ("C.3", "Implementation Discrepancy", "P1"),
    ("C.4", "Execution Faults & Numerical Instability", "P4"),
    ("C.5", "Infrastructure Error Misdiagnosis", "P4"),
    ("C.6", "Search Space Local Optimization", "P2"),
    ("C.7", "Premature Termination", "P2"),
    ("C.8", "Environment Interaction Failure", "P4"),
    ("D.1", "Artifacts as Insights", "P1"),
    ("D.2", "Confirmation Bias", "P3"),
    ("D.3", "Statistical Misuse", "P3"),
    ("D.4", "Method-Conclusion Disconnect", "P1"),
    ("D.5", "Baseline & Ablation Deficit", "P2"),
    ("D.6", "Result Hallucination", "P1"),
    ("D.7", "Unremediated Adversarial Evidence", "P3"),
    ("E.1", "Report-Code Traceability Gap", "P1"),
    ("E.2", "Overclaiming & Selective Narrative", "P3"),
    ("E.3", "Omission of Critical Limitations", "P3"),
    ("E.4", "Methodological & Citation Fabrication", "P1"),
    ("F.1", "Superficial Self-Review", "P2"),
    ("F.2", "Failure to Gate Critical Flaws", "P2"),
    ("F.3", "Lack of Adversarial Perspective", "P2"),
    ("F.4", "Uncorrected Self-Awareness", "P2"),
    ("F.5", "Review Score Hacking", "P3"),
    ("F.6", "Hallucinated Reviewing", "P1"),
    ("X.1", "Cascading Error Propagation", "P4"),
    ("X.2", "Goal Drift", "P3"),
    ("X.3", "Skeptical Reasoning Deficit", "P2"),
    ("X.4", '"Honest-but-Hollow" Output', "P3"),
    ("X.5", "Teleological Reasoning", "P3"),
    ("X.6", "Right-for-the-Wrong-Reason", "P1"),
    ("X.7", "Cognitive Anchoring & Re-planning Failure", "P2"),
    ("X.8", "Engineering Delivery Failure", "P4"),
]
STAGES = {
    "A": "Ideation & Planning",
    "B": "Retrieval & Synthesis",
    "C": "Execution & Implementation",
    "D": "Analysis & Interpretation",
    "E": "Writing & Documentation",
    "F": "Self-Verification & Review",
    "X": "Cross-Cutting Meta-Failures",
}
PILLARS = {
    "P1": "Grounding & Faithfulness",
    "P2": "Cognitive Depth & Adaptability",
    "P3": "Integrity & Alignment",
    "P4": "Engineering Robustness",
}
# The word for each pillar in an issue's trailer; severities; score codes.
PILLAR_WORDS = {"P1": "grounding", "P2": "depth", "P3": "integrity", "P4": "robustness"}
SEVERITIES = ("high", "medium", "low", "none")
MISS, PARTIAL, HIT = 0, 1, 2

_ROWS = [(i, code, name, code[0], pillar) for i, (code, name, pillar) in enumerate(CODES)]


def dim_code(spark: SparkSession) -> DataFrame:
    """ord, code, name, stage, pillar: 45 rows, safe to broadcast."""
    return spark.createDataFrame(_ROWS, "ord int, code string, name string, stage string, pillar string")


def dim_stage(spark: SparkSession) -> DataFrame:
    """stage, stage_name in order."""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(STAGES.items())], "stage_ord int, stage string, stage_name string")


def dim_pillar(spark: SparkSession) -> DataFrame:
    """pillar, pillar_name, word."""
    return spark.createDataFrame([(p, n, PILLAR_WORDS[p]) for p, n in PILLARS.items()], "pillar string, pillar_name string, word string")


def dim_code_sql() -> str:
    """The code dimension as a common table expression."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(c)}, {quote(n)}, {quote(s)}, {quote(p)})" for i, c, n, s, p in _ROWS)
    return f"dim(ord, code, name, stage, pillar) AS (VALUES {rows})"


def codes_text(definitions: dict[str, str] | None = None) -> str:
    """The cheat sheet of valid codes by stage, and the pillars' members."""
    lines = [f"Valid pattern codes (use ONLY these {len(CODES)} ids; omit a code entirely if it does not apply):"]
    for stage, title in STAGES.items():
        lines.append(f"\n[{stage}] {title}")
        lines += [f"  {code} {name}" + (f" — {definitions[code]}" if definitions else "") for code, name, _ in CODES if code[0] == stage]
    lines.append("\nRoot-cause pillars (derived automatically from the code; do not output them):")
    lines += [f"  {p} {title}: {', '.join(c for c, _, q in CODES if q == p)}" for p, title in PILLARS.items()]
    return "\n".join(lines) + "\n"
