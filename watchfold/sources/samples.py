"""A generator of sample log lines: background noise of all four record kinds, and attack scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import col, lit

START_S = 1_782_858_000


def _pick(names: list[str], seed: int):
    return F.element_at(F.array(*map(lit, names)), (F.pmod(F.xxhash64("id", lit(seed)), lit(len(names))) + 1).cast("int"))


def noise(spark: SparkSession, n: int, hosts: int = 35, users: int = 15, seed: int = 1337) -> DataFrame:
    """(id, value): n lines, a quarter of each kind, over ``hosts`` hosts and ``users`` users; no line is read back from the driver."""
    draw = lambda k, of: F.pmod(F.xxhash64("id", lit(seed + k)), lit(of))
    host, user = F.format_string("HOST-%02d", draw(1, hosts)), F.format_string("user%02d", draw(2, users))
    ip, second = F.format_string("10.0.0.%d", draw(1, hosts) + 1), (lit(START_S) + col("id"))
    pid = draw(3, 9000) + 1000
    head = lambda mark: F.concat(lit("OPLC-acme,"), (second * 1000).cast("string"), lit(","), ip, lit(" #"), second.cast("string"), lit(","), host, lit(","), ip, lit(mark))
    names = ["svchost.exe", "chrome.exe", "explorer.exe", "outlook.exe", "teams.exe"]
    process = F.concat(head(",P,NEW_PROCESS,"), pid.cast("string"), lit(","), _pick(names, 4), lit(",C:\\Windows\\"), _pick(names, 4), lit(",C:\\Windows,CORP\\"), user, lit(",4,wininit.exe"))
    network = F.concat(head(",N,NETWORK,TCP,"), ip, lit(","), (draw(5, 20000) + 40000).cast("string"), lit(",203.0.113."), draw(6, 250).cast("string"), lit(",443,"), pid.cast("string"), lit(","), _pick(names, 4))
    integrity = F.concat(head(",I,FILE_INTEGRITY,,"), _pick(["CREATED", "MODIFIED", "DELETED"], 7), lit(",C:\\Data\\file"), draw(8, 500).cast("string"), lit(".txt,"), F.md5(col("id").cast("string")))
    when = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    logon = F.concat(head(",E,"), _xml(_pick(["4624", "4634", "4672", "4673"], 9), when, host, {"TargetUserName": user, "TargetDomainName": lit("CORP"), "IpAddress": ip, "LogonType": lit("2")}))
    kind = F.pmod(col("id"), lit(4))
    return spark.range(n).select("id", F.when(kind == 0, process).when(kind == 1, network).when(kind == 2, integrity).otherwise(logon).alias("value"))


def _xml(event_id, when, host, data: dict):
    parts = [lit("<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><EventID>"), event_id, lit("</EventID><TimeCreated SystemTime='"),
             when, lit("'/><Computer>"), host, lit("</Computer></System><EventData>")]
    for name, value in data.items():
        parts += [lit(f"<Data Name='{name}'>"), value, lit("</Data>")]
    return F.concat(*parts, lit("</EventData></Event>"))


def scenarios() -> list[str]:
    """Lines of attacks that rules should find: failed logons, then a success; an encoded command; a new member of an admin group; discovery; a remote service."""
    from datetime import UTC, datetime

    lines, now = [], START_S + 1_000_000

    def event(code: str, host: str, **data: str) -> None:
        nonlocal now
        now += 1
        iso = datetime.fromtimestamp(now, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        fields = "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in data.items())
        lines.append(f"OPLC-acme,{now * 1000},10.0.0.99 #{now},{host},10.0.0.99,E,<Event><System><EventID>{code}</EventID><TimeCreated SystemTime='{iso}'/>"
                     f"<Computer>{host}</Computer></System><EventData>{fields}</EventData></Event>")

    def process(host: str, pid: int, name: str, parent: int) -> None:
        nonlocal now
        now += 1
        lines.append(f"OPLC-acme,{now * 1000},10.0.0.99 #3.4.8,{now},{host},10.0.0.99,P,NEW_PROCESS,{pid},{name},C:\\Windows\\{name},C:\\Windows,CORP\\mallory,{parent},cmd.exe")

    for _ in range(20):
        event("4625", "DC-01", TargetUserName="alice", TargetDomainName="CORP", IpAddress="10.0.0.77", LogonType="3")
    event("4624", "DC-01", TargetUserName="alice", TargetDomainName="CORP", IpAddress="10.0.0.77", LogonType="3")
    event("4688", "WS-07", NewProcessName="powershell.exe", NewProcessId="0x1a2b", CommandLine="powershell -encodedcommand SQBFAFgA", SubjectUserName="mallory", SubjectDomainName="CORP")
    event("4732", "DC-01", MemberName="mallory", TargetUserName="Domain Admins", SubjectUserName="alice")
    for i, name in enumerate(["systeminfo.exe", "whoami.exe", "ipconfig.exe", "netstat.exe", "whoami.exe"]):
        process("WS-07", 7000 + i, name, 6699)
    process("SRV-02", 8100, "psexesvc.exe", 4)
    event("4688", "DC-01", NewProcessName="cmd.exe", NewProcessId="0x2000", CommandLine="procdump -ma lsass.exe", SubjectUserName="mallory", SubjectDomainName="CORP")
    return lines
