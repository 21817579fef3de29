"""Settings of a scan, with their defaults and limits."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ScanConfig:
    top_k: int = 50
    #: Bytes of a payload that the keyword search looks at; 0 turns it off.
    payload_max: int = 512
    portscan_threshold: int = 64
    portscan_window_seconds: int = 10
    #: Alerts that are written, 0 for all; counters always count all.
    max_alerts: int = 0
    enable_carving: bool = False
    redact_secrets: bool = True
    dns_tunnel_entropy: float = 3.5
    dns_tunnel_len: int = 50
    beaconing_min_count: int = 10
    beaconing_tolerance: float = 0.1
    exfil_bytes_threshold: int = 10_000_000
    #: "ext", or "legacy": IPv4 only, four kinds of alerts.
    profile: str = "ext"
    #: One port-scan alert for each window instead of one for each packet at the threshold.
    portscan_once: bool = False

    def __post_init__(self) -> None:
        for name, least in (("top_k", 1), ("payload_max", 0), ("portscan_threshold", 1), ("portscan_window_seconds", 1), ("max_alerts", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if self.profile not in ("ext", "legacy"):
            raise ValueError("profile must be ext or legacy")

    @classmethod
    def of(cls, **given: object) -> ScanConfig:
        known = {f.name for f in fields(cls)}
        if wrong := sorted(set(given) - known):
            raise ValueError(f"unknown settings: {', '.join(wrong)}")
        return cls(**given)
