"""Fixed values every part of the library must agree on."""

# Identifier lengths, in UTF-8 bytes.
MAX_NAME_BYTES = 128
MAX_ID_BYTES = 512

# Ingest bounds.
MAX_PAYLOAD_BYTES = 64 * 1024
MAX_BODY_BYTES = 4 * 1024 * 1024
MAX_BATCH_OPS = 1000

# Page bounds: default and largest record count, default and largest byte budget.
DEFAULT_PAGE_RECORDS = 100
MAX_PAGE_RECORDS = 1000
DEFAULT_PAGE_BYTES = 1024 * 1024
MAX_PAGE_BYTES = 4 * 1024 * 1024

# Seconds a shared cache may keep an answer, when a collection does not say.
DEFAULT_SHARED_MAX_AGE = 300

# Deepest nesting a document may have.
MAX_JSON_DEPTH = 128

# The payload of a tombstone and the SHA-256 of that text.
EMPTY_DOCUMENT = "{}"
EMPTY_DOCUMENT_HASH = "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"


def clamp_records(requested: int | None) -> int:
    """A page size inside the allowed range; 0 becomes 1."""
    if requested is None:
        return DEFAULT_PAGE_RECORDS
    return max(1, min(int(requested), MAX_PAGE_RECORDS))


def clamp_bytes(requested: int | None) -> int:
    """A byte budget inside the allowed range; 0 becomes 1."""
    if requested is None:
        return DEFAULT_PAGE_BYTES
    return max(1, min(int(requested), MAX_PAGE_BYTES))
