"""The canonical event: names and types of its columns, and the fixed tables used to fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ("info", "low", "medium", "high", "critical")

#: The columns of an event, by type.
TEXTS = (
    "source", "timestamp", "host", "category", "action", "outcome", "exe", "exe_name", "exe_dir", "comm", "cmdline", "cwd", "parent_exe", "parent_name",
    "tty", "interpreter", "user", "euser", "auser", "path", "file_name", "file_ext", "file_dir", "mode", "nametype", "remote_ip", "local_ip",
    "addr_family", "socket_path", "syscall", "syscall_name", "key", "serial", "event_id", "arch", "proctitle", "message", "message_snippet", "unit",
    "service", "syslog_id", "priority_label", "boot_id", "machine_id", "auth_user", "auth_method", "auth_result", "sudo_command", "sudo_target_user",
    "http_method", "http_path", "http_query", "http_version", "user_agent", "referer", "virtual_host", "raw",
)
WHOLE_NUMBERS = (
    "argc", "pid", "ppid", "session", "uid", "euid", "suid", "fsuid", "auid", "gid", "egid", "owner_uid", "owner_gid", "remote_port", "local_port",
    "open_flags", "exit_code", "priority", "facility", "http_status", "bytes_sent",
)
NUMBERS = ("epoch", "request_time")
FLAGS = (
    "success", "interactive", "is_script", "is_root", "is_system_user", "priv_escalated", "auid_set", "is_setuid", "is_setgid", "is_write", "is_error",
    "is_warning",
)
LISTS = ("argv", "paths", "keys", "record_types")

EVENT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in TEXTS],
    *[T.StructField(n, T.LongType()) for n in WHOLE_NUMBERS],
    *[T.StructField(n, T.DoubleType()) for n in NUMBERS],
    *[T.StructField(n, T.BooleanType()) for n in FLAGS],
    *[T.StructField(n, T.ArrayType(T.StringType())) for n in LISTS],
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.StringType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

#: Short forms of column names that rules may use.
ALIASES = {
    "command_line": "cmdline", "process_name": "exe_name", "exe_basename": "exe_name", "process_path": "exe", "process_id": "pid",
    "parent_pid": "ppid", "parent_process_name": "parent_name", "parent_process_path": "parent_exe", "filepath": "path", "filepaths": "paths",
    "target_path": "path", "log_message": "message", "log_unit": "unit", "service_name": "service", "log_priority": "priority",
    "log_priority_label": "priority_label", "log_facility": "facility", "success_bool": "success", "ppid_name": "parent_name", "ppid_path": "parent_exe",
}

#: x86-64 system call numbers, as audit records write them.
SYSCALLS = {
    "0": "read", "1": "write", "2": "open", "3": "close", "4": "stat", "5": "fstat", "6": "lstat", "8": "lseek", "9": "mmap", "10": "mprotect",
    "21": "access", "22": "pipe", "32": "dup", "33": "dup2", "41": "socket", "42": "connect", "43": "accept", "44": "sendto", "45": "recvfrom",
    "46": "sendmsg", "47": "recvmsg", "48": "shutdown", "49": "bind", "50": "listen", "56": "clone", "57": "fork", "58": "vfork", "59": "execve",
    "62": "kill", "82": "rename", "83": "mkdir", "84": "rmdir", "85": "creat", "86": "link", "87": "unlink", "88": "symlink", "90": "chmod",
    "91": "fchmod", "92": "chown", "93": "fchown", "94": "lchown", "101": "ptrace", "105": "setuid", "106": "setgid", "113": "setreuid",
    "114": "setregid", "117": "setresuid", "119": "setresgid", "133": "mknod", "155": "pivot_root", "161": "chroot", "165": "mount", "166": "umount2",
    "169": "reboot", "175": "init_module", "176": "delete_module", "180": "quotactl", "246": "kexec_load", "257": "openat", "258": "mkdirat",
    "259": "mknodat", "260": "fchownat", "263": "unlinkat", "264": "renameat", "265": "linkat", "266": "symlinkat", "268": "fchmodat", "280": "utimensat",
    "288": "accept4", "313": "finit_module", "316": "renameat2", "317": "seccomp", "319": "memfd_create", "321": "bpf", "322": "execveat",
    "424": "pidfd_send_signal", "435": "clone3",
}

#: The category of events by system call.
SYSCALL_CATEGORIES = {
    "process": ("execve", "execveat", "clone", "fork", "vfork", "clone3"),
    "file": (
        "open", "openat", "creat", "unlink", "unlinkat", "rename", "renameat", "renameat2", "link", "linkat", "symlink", "symlinkat", "mkdir", "mkdirat",
        "rmdir", "chmod", "fchmod", "fchmodat", "chown", "fchown", "fchownat", "lchown", "truncate", "ftruncate", "mknod", "mknodat", "write", "utimensat",
        "mount", "umount2", "pivot_root", "chroot",
    ),
    "network": ("socket", "connect", "bind", "listen", "accept", "accept4", "sendto", "recvfrom", "sendmsg", "recvmsg"),
    "privilege": ("setuid", "setgid", "setreuid", "setregid", "setresuid", "setresgid", "capset", "ptrace"),
    "module": ("init_module", "finit_module", "delete_module"),
}
#: System calls that change files whatever their arguments.
MUTATING = (
    "write", "pwrite64", "writev", "truncate", "ftruncate", "rename", "renameat", "renameat2", "unlink", "unlinkat", "link", "linkat", "symlink",
    "symlinkat", "mkdir", "mkdirat", "rmdir", "creat", "mknod", "mknodat", "chmod", "fchmod", "fchmodat", "chown", "fchown", "fchownat", "lchown",
    "utimensat", "setxattr", "lsetxattr", "fsetxattr", "removexattr",
)
#: Names of interpreters.
INTERPRETERS = (
    "bash", "sh", "dash", "zsh", "ksh", "csh", "tcsh", "fish", "python", "python2", "python3", "perl", "ruby", "php", "lua", "node", "nodejs", "awk",
    "gawk",
)
#: Syslog priorities 0 to 7.
PRIORITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")


def lookup(column: Column, values: dict) -> Column:
    """The value of a small fixed table; null for what is not in it."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.when(column.isNotNull(), table[column])


def severity_rank(column: Column) -> Column:
    """0 for info to 4 for critical, -1 for anything else."""
    return F.coalesce(lookup(F.lower(F.trim(column)), {s: i for i, s in enumerate(SEVERITIES)}), F.lit(-1))


def canonical(df: DataFrame) -> DataFrame:
    """df with all canonical columns, in order and typed; those that it lacks are null, others are dropped."""
    there = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in EVENT])


def line_key(feed: str, lines: DataFrame) -> Column:
    """What names a line of a feed: seq where the lines have it (see ``feeds.numbered_lines``), else made of their path, if any, and pos."""
    if "seq" in lines.columns:
        return F.col("seq")
    pos, path = lines.schema["pos"].dataType, F.col("path") if "path" in lines.columns else F.lit("")
    if not isinstance(pos, T.IntegralType):
        return F.md5(F.concat_ws("\x1f", F.lit(feed), path, F.col("pos").cast("string")))
    return sortable_key(F.col("pos"), F.md5(F.concat(F.lit(f"{feed}\x1f"), F.coalesce(path, F.lit("")))))


def sortable_key(number: Column, digest: Column) -> Column:
    """128 bits in hexadecimal digits: 40 of a line's number, so that keys of a file sort as its lines, and 88 of a digest of its feed and file."""
    return F.concat(F.lpad(F.hex(number.cast("long")), 10, "0"), F.substring(digest, 1, 22))


def with_aliases(df: DataFrame) -> DataFrame:
    """The columns under their short forms too."""
    return df.withColumns({a: F.col(c) for a, c in ALIASES.items() if c in df.columns and a not in df.columns})


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """All feeds in the canonical schema, one after the other."""
    out = canonical(feeds[0])
    for f in feeds[1:]:
        out = out.unionByName(canonical(f))
    return out
