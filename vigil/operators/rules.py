"""Rule and check definitions and their registries."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from vigil.operators.conditions import Condition
from vigil.operators.temporal import TemporalJoin


@dataclass(frozen=True)
class Rule:
    """Process-gap rule. Built-in codes have their own plan; others are evaluated from the definition."""

    code: str
    name: str
    target_dataset: str
    severity_base: int = 70
    confidence: float = 0.95
    category: str = "COMPLIANCE_GAP"
    condition: Condition | None = None
    join: TemporalJoin | None = None
    description: str = ""
    rationale: str = ""
    recommendation: str | None = None
    is_active: bool = True


@dataclass(frozen=True)
class Check:
    """Absence check: constants may be changed, the logic belongs to the id."""

    code: str
    name: str
    category: str
    severity_base: int
    confidence: float
    min_sample: int
    recommendation: str | None = None
    is_active: bool = True


@dataclass
class Registry:
    """Definitions by code."""

    entries: dict[str, Rule | Check] = field(default_factory=dict)
    fixed_codes: bool = False  # only known codes may be registered

    def register(self, definition: Rule | Check) -> None:
        if self.fixed_codes and definition.code not in self.entries:
            raise ValueError(f"no logic exists for check {definition.code!r}")
        self.entries[definition.code] = definition

    def get(self, code: str) -> Rule | Check | None:
        return self.entries.get(code)

    def enable(self, code: str, active: bool = True) -> bool:
        if code not in self.entries:
            return False
        self.entries[code] = replace(self.entries[code], is_active=active)
        return True

    def list(self, active_only: bool = True) -> list[Rule | Check]:
        return [d for d in self.entries.values() if d.is_active or not active_only]


# The built-in rules (code, name, category, dataset, base score, confidence, advice).
BUILTIN_RULES = (
    ("EG-01", "Uninvestigated Critical / High Alerts", "TRIAGE_FAILURE", "alert_metadata", 70, 0.95,
     "Enforce immediate triage desk assignment and investigate unhandled high/critical priority alerts."),
    ("EG-02", "Missing Escalation After Severity Threshold", "ESCALATION_BYPASS", "case_management", 85, 0.90,
     "Trigger automatic escalation pathway to Tier-2/Tier-3 IR when P1 cases exceed 4 hours."),
    ("EG-03", "Stale Open Cases", "SLA_DEFICIT", "case_management", 50, 0.85,
     "Review stale case backlog and reassign or close dormant tickets with updated audit notes."),
    ("EG-04", "Case Closure Without Resolution Notes", "DILIGENCE_FAILURE", "case_management", 75, 0.95,
     "Enforce mandatory minimum 20-character technical justification for all case closures."),
    ("EG-05", "Unassigned Critical Assets in Alerts", "ASSET_GOVERNANCE", "alert_metadata", 65, 0.90,
     "Update asset CMDB inventory to assign accountable system owners and escalation contacts."),
    ("EG-06", "Escalation Without Incident Record", "INCIDENT_BYPASS", "escalation_records", 80, 0.88,
     "Formalize high-tier escalations by declaring incident records with root-cause analysis."),
    ("EG-07", "Rapid Batch Case Dismissal (Rubber-Stamping)", "QUALITY_COMPROMISE", "case_management", 90, 0.92,
     "Audit bulk dismissal practices and implement rate limiting on analyst case closures."),
    ("EG-08", "Off-Hours Critical Alert SLA Breach", "OFF_HOURS_DEFICIT", "alert_metadata", 85, 0.90,
     "Establish on-call 24x7 escalation rotation to handle off-hours and weekend alerts within SLA."),
)

# The built-in absence checks (code, name, category, base score, confidence, samples, advice).
BUILTIN_CHECKS = (
    ("NS-01", "EWMA Volume Cliff / Sudden Sensor Silence", "LOG_SILENCE", 85, 0.90, 15,
     "Verify network sensor connectivity and SIEM collector health immediately."),
    ("NS-02", "Missing Weekend / Off-Hours Analyst Activity", "COVERAGE_VACUUM", 80, 0.95, 20,
     "Establish weekend on-call monitoring coverage or automated alert response playbooks."),
    ("NS-03", "Zero Coverage on Crown-Jewel Assets", "ASSET_BLINDNESS", 95, 0.98, 1,
     "Deploy required EDR and security monitoring agents to all unmonitored Crown Jewel systems."),
    ("NS-04", "Asymmetric Case Closure vs Creation Rate", "BACKLOG_SURGE", 75, 0.85, 30,
     "Increase SOC triage capacity to prevent unmanageable incident queue buildup."),
    ("NS-05", "Missing Escalations on High-Severity Alert Spike", "ESCALATION_BLINDNESS", 88, 0.88, 20,
     "Audit triage procedures to ensure critical alert surges trigger prompt senior escalation."),
    ("NS-06", "Low Categorical Shannon Entropy (Monoculture / Blinded Rules)", "MONOCULTURE_BLINDNESS", 70, 0.82, 50,
     "Audit SIEM detection rule enablement to ensure multi-vector attack detection coverage."),
    ("NS-07", "Unnaturally Constant Alert Intervals (Synthetic Heartbeat)", "SYNTHETIC_DATA_RISK", 85, 0.92, 20,
     "Inspect telemetry ingestion pipeline for mocked or looping synthetic telemetry sources."),
    ("NS-08", "Missing Post-Incident Remediation / Audit Trace", "REMEDIATION_GAP", 65, 0.80, 1,
     "Conduct mandatory post-incident review and register architectural remediation updates."),
)


def rule_registry() -> Registry:
    registry = Registry()
    for code, name, category, dataset, base, confidence, advice in BUILTIN_RULES:
        registry.register(
            Rule(code, name, dataset, base, confidence, category, recommendation=advice)
        )
    return registry


def check_registry() -> Registry:
    entries = {
        code: Check(code, name, category, base, confidence, samples, advice)
        for code, name, category, base, confidence, samples, advice in BUILTIN_CHECKS
    }
    return Registry(entries, fixed_codes=True)
