"""One exception with a stable code for every refusal."""

# The codes callers may test for.
CODES = (
    "not_found", "invalid_interval", "missing_actor", "unknown_kind", "unknown_intent", "invalid_meta", "invalid_field",
    "zero_tx_time", "codec", "invalid_cursor", "invalid_path", "missing_entity_id", "closed", "conflict", "missing_hold_id",
    "hold_exists", "hold_released", "current_record", "no_chain", "reserved_meta", "shredded", "key_destroyed", "no_keyring",
    "no_policy", "invalid_policy", "no_deleter",
    "invalid_argument",
)

# What a service in front of the library answers for each code, and its page sizes.
STATUS = {
    "shredded": (410, "shredded"), "key_destroyed": (410, "key_destroyed"), "no_keyring": (501, "no_keyring"),
    "not_found": (404, "not_found"), "no_chain": (404, "no_chain"), "conflict": (409, "conflict"), "codec": (422, "codec"),
    "hold_exists": (409, "hold_exists"), "hold_released": (409, "hold_released"), "current_record": (409, "current_record"),
    "no_deleter": (501, "unsupported"), "closed": (503, "unavailable"), "missing_actor": (500, "internal"), "zero_tx_time": (500, "internal"),
}
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


class HistoryError(Exception):
    def __init__(self, code: str, message: str = ""):
        assert code in CODES, code
        self.code = code
        super().__init__(f"{code}: {message}" if message else code)


def answer(e: Exception) -> tuple[int, str]:
    """(status, code) of an error; a code not in STATUS is the caller's fault, any other exception nobody's business."""
    return STATUS.get(e.code, (400, e.code)) if isinstance(e, HistoryError) else (500, "internal")


def page_limit(text: str | None) -> int:
    """The number of rows a service gives: DEFAULT_LIMIT if none is asked for, 1 to MAX_LIMIT else."""
    if text is None:
        return DEFAULT_LIMIT
    if not text.isascii() or not text.isdigit() or not 1 <= int(text) <= MAX_LIMIT:
        raise HistoryError("invalid_argument", f"limit is a number from 1 to {MAX_LIMIT}, not {text!r}")
    return int(text)
