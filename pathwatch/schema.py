"""Fixed schemas and the parameters of an experiment."""

from __future__ import annotations

from dataclasses import asdict, dataclass

REPLY = "struct<`from`:string,rtt:double,ttl:int,size:int,err:string,x:string>"
HOPS = f"array<struct<hop:int,error:string,result:array<{REPLY}>>>"
#: One traceroute. Never inferred: rare keys would change the schema from file to file.
TRACEROUTE = f"timestamp long, endtime long, af int, msm_id long, prb_id long, `from` string, src_addr string, dst_addr string, dst_name string, proto string, type string, msm_name string, paris_id int, size int, fw int, lts int, result {HOPS}"
PREFIXES = "prefix string, masklen int, asn long, asname string, country string"
DELAY_REFERENCE = "ip1 string, ip2 string, mean double, high double, low double, boot array<struct<med:double,hi:double,lo:double>>, first_seen long, last_seen long, nb_seen int, nb_reported int, nb_trimmed int"
FORWARDING_REFERENCE = "dst string, ip0 string, ref map<string,double>, first_seen long, last_seen long, nb_seen int, nb_reported int"
#: What stored alarms and magnitudes hold beside their measurements; a table without a row has no schema of its own.
DELAY_ALARM = "time_bin long, ip1 string, ip2 string, n long, median double, lo double, hi double, ref double, ref_low double, ref_high double, nb_seen int, diff double, diff_med double, deviation double, dev_bound double"
FORWARDING_ALARM = "time_bin long, dst string, ip0 string, corr double, nb_samples int, nb_peers int, nb_seen int"
MAGNITUDE = "asn long, time_bin long, value double, magnitude double"


@dataclass(frozen=True)
class Params:
    """Parameters of one experiment; times are epoch seconds."""

    exp_id: str = "default"
    window: int = 3600
    start: int = 0
    end: int = 1 << 40
    alpha: float = 0.01
    confidence: float = 0.05
    min_asn: int = 3
    min_entropy: float = 0.5
    min_seen: int = 3
    min_corr: float = -0.25
    af: int = 4
    prefixes: str | None = None
    stream: bool = False
    expire_days: int | None = None
    comment: str = ""

    def as_row(self) -> dict:
        return asdict(self)
