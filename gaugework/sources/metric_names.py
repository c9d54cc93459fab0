"""Names of the metric table."""

from __future__ import annotations

# The header of the metric table, by group and in order.
HEADER = (
    "timestamp,"
    "cpu.%usr,cpu.%nice,cpu.%sys,cpu.%iowait,cpu.%steal,cpu.%irq,cpu.%soft,cpu.%guest,cpu.%gnice,cpu.%idle,"
    "task.proc/s,task.cswch/s,intr.intr/s,swap.pswpin/s,swap.pswpout/s,"
    "paging.pgpgin/s,paging.pgpgout/s,paging.fault/s,paging.majflt/s,paging.pgfree/s,paging.pgscank/s,"
    "paging.pgscand/s,paging.pgsteal/s,paging.%vmeff,"
    "io.tps,io.rtps,io.wtps,io.bread/s,io.bwrtn/s,"
    "memory.kbmemfree,memory.kbavail,memory.kbmemused,memory.%memused,memory.kbbuffers,memory.kbcached,"
    "memory.kbcommit,memory.%commit,memory.kbactive,memory.kbinact,memory.kbdirty,memory.kbanonpg,"
    "memory.kbslab,memory.kbkstack,memory.kbpgtbl,memory.kbvmused,"
    "swap.kbswpfree,swap.kbswpused,swap.%swpused,swap.kbswpcad,swap.%swpcad,"
    "load.runq-sz,load.plist-sz,load.ldavg-1,load.ldavg-5,load.ldavg-15,load.blocked,"
    "disk.tps,disk.rd_sec/s,disk.wr_sec/s,disk.avgrq-sz,disk.avgqu-sz,disk.await,disk.svctm,disk.%util,"
    "network.rxpck/s,network.txpck/s,network.rxkB/s,network.txkB/s,network.rxcmp/s,network.txcmp/s,"
    "network.rxmcst/s,network.%ifutil"
)

METRIC_COLUMNS = HEADER.split(",")
GENERAL_METRICS = [c for c in METRIC_COLUMNS[1:] if not c.startswith(("disk.", "network."))]
DISK_METRICS = [c for c in METRIC_COLUMNS if c.startswith("disk.")]
NETWORK_METRICS = [c for c in METRIC_COLUMNS if c.startswith("network.")]


def plain_name(name: str) -> str:
    """A name that needs no quoting in SQL: ``cpu.%usr`` becomes ``cpu_pct_usr``."""
    return name.replace("%", "pct_").replace("/s", "_per_s").replace(".", "_").replace("-", "_")


PLAIN_COLUMNS = [plain_name(c) for c in METRIC_COLUMNS]
