"""Tables of abbreviations that names are read with."""

from __future__ import annotations

from dataclasses import dataclass, field

# What the parts of a split name are written out as.
EXPANSIONS = {
    "mem": "memory", "char": "character", "arg": "argument", "att": "attribute", "attr": "attribute", "a11y": "accessibility",
    "algo": "algorithm", "cmp": "compare", "cpy": "copy", "str": "string", "mov": "move", "ins": "insert", "init": "initialize",
    "ini": "initialize", "deinit": "remove_initialize", "fini": "finalize", "va": "various_arguments", "msg": "message",
    "ts": "timestamp", "intel": "computer_architecture", "int": "integer", "buf": "buffer", "buff": "buffer", "sep": "separate",
    "gcc": "compiler", "clang": "compiler", "wdb": "wind_debug", "db": "database", "dblogs": "db_logs", "cb": "callback",
    "hw": "hardware", "profil": "profile", "contrl": "control", "conn": "connect", "cat": "catalog", "sig": "signal",
    "jmp": "jump", "proc": "process", "eval": "evaluate", "gen": "generate", "abrt": "abort", "alloc": "allocate",
    "malloc": "memory_allocate", "sys": "system", "io": "io", "dup": "duplicate", "fcn": "function", "fn": "function",
    "func": "function", "na": "nan", "opt": "option", "aux": "auxiliary", "mul": "multiply", "div": "divide", "subj": "subject",
    "seg": "segment", "loc": "location", "id": "identifier", "iter": "iterate", "err": "error", "stp": "string_pointer",
    "len": "length", "delim": "delimiter", "sched": "schedule", "info": "information", "stdin": "standard_in",
    "std": "standard", "tmp": "temp", "cksum": "check_sum", "resolv": "resolve", "lst": "list", "que": "queue", "lck": "lock",
    "unlck": "unlock", "reg": "register", "stat": "status", "dir": "directory", "mmap": "memory_map", "punct": "punctuation",
    "res": "resource", "eq": "equal", "conv": "convert", "async": "asynchronous", "sync": "synchronous",
    "fd": "file_descriptor", "alnum": "alpha_numeric", "avg": "average", "cwd": "current_working_directory",
    "pwd": "print_working_directory", "lib": "library", "conf": "configuration", "os": "operating_system", "chr": "character",
    "src": "source", "dst": "destination", "dest": "destination", "tow": "to_wide", "dl": "dynamically_linked",
    "tty": "terminal", "pts": "pseudo_terminal", "cspn": "character_span", "dents": "directory_entries", "tz": "time_zone",
    "wc": "wide_character", "gz": "gzip", "mk": "make", "rm": "remove", "param": "parameter", "rtn": "return", "rcv": "receive",
    "fsck": "file_system_check", "nat": "network_address_translation", "toa": "to_ascii", "pos": "position", "chk": "check",
    "expr": "expression", "ind": "index", "errno": "error", "assert": "assertion", "addr": "address", "ux": "user_interface",
    "p2p": "peer_to_peer", "tbl": "table", "settime": "set_time", "tgt": "target", "der": "distinguished_encoding_rules",
    "ber": "basic_encoding_rules", "rdn": "relative_distinguished_name", "clearerr": "clear_error",
    "altsetting": "alternative_setting", "env": "environment", "usr": "user", "creat": "create", "sock": "socket",
    "setsockopt": "set_socket_option", "clust": "cluster", "cvt": "convert", "num": "number", "cond": "condition",
    "mcmp": "compare", "hook": "hook", "to": "to", "i18n": "i18n", "posix": "posix", "amd": "computer_architecture",
    "dma": "direct_memory_access", "seterrno": "set_error", "md": "md5", "fat": "fat16",
}

# Words that are two or more, by blanks.
SPLITS = {
    "deinit": "de init", "wdb": "w db", "tildexpand": "tild expand", "timesend": "time send", "timeset": "time set",
    "timestamp": "time stamp", "makesuffix": "make suffix", "timediff": "time diff", "dblogs": "db logs", "malloc": "m alloc",
    "settime": "set time", "clearerr": "clear err", "altsetting": "alt setting", "setsockopt": "set sock opt",
    "seterrno": "set err no", "coldef": "col def", "checksig": "check sig",
}


@dataclass(frozen=True)
class Lexicon:
    """What the rule splitter knows. words: known words; abbreviations: each with the words it may stand for, in the order
    they are tried; stopwords: common words, in that order, too. The tables are parameters; by default an abbreviation
    stands for its expansion's words."""

    words: frozenset[str] = frozenset()
    abbreviations: dict[str, tuple[str, ...]] = field(default_factory=lambda: {k: (v,) for k, v in EXPANSIONS.items()})
    stopwords: tuple[str, ...] = ()
    splits: dict[str, str] = field(default_factory=lambda: dict(SPLITS))
