"""Fixed values. Every value in this module must equal the studied tool's value
for results to match; they are listed plainly and in their natural order."""

# --- fixed values: default English stop words of the analyzer (33 words) ---
DEFAULT_STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such "
    "that the their then there these they this to was will with"
).split()

# --- fixed values: single characters that are always stop words (68) ---
STOP_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789`~!@#$%^&*()-_=+[{]}\\|;:'\",<.>/?"

# --- fixed values: file-type priority by lower-cased extension ---
HIGH_PRIORITY_TYPES = ("doc", "htm", "html", "pdf", "ppt", "pst", "txt", "xls", "zip")
# "Evt" is mixed case in the original list and can never match a lower-cased extension.
MED_PRIORITY_TYPES = ("bak", "dat", "data", "db", "dot", "dtd", "Evt", "ini", "json", "lnk",
                      "msg", "rar", "sql", "sqlite", "sys", "tif", "tmp", "url", "xml")

# --- fixed values: system directory markers (substring match on the path) ---
SYSTEM_DIRS = ("WINDOWS/", "System Volume Information/", "Program Files/", "Program Files (x86)/",
               "ProgramData", "bin/", "boot/", "dev/", "etc/", "initrd/", "lib/", "lib64/", "mnt/",
               "opt/", "proc/", "sbin/", "srv/", "sys/", "tmp/", "usr/", "var/")

UNALLOCATED_PREFIX = "$Unallocated/"

# --- fixed values: hit features, in model order, and the two linear models ---
HIT_FEATURES = ("created", "modified", "accessed", "avg_recency", "filename_direct",
                "filename_indirect", "system_dir", "high_type", "med_type", "low_type",
                "term_tfidf", "similarity", "hit_frequency", "proximity", "term_cardinality",
                "term_length", "term_priority", "unused", "hit_offset")
ALLOCATED_WEIGHTS = (-28.19132113248016, -3.493369555294129, 30.12105381917877,
                     0.002986570737990329, 0.7827037719379998, 1.929623512361485,
                     -0.9514731461745805, 0.306156721829065, 0.9537708670308881,
                     0.9162126105417191, 2.421379822295228, -0.8792006472897821,
                     -0.185233539168734, -1.012669050673611, 1.164585079023337,
                     4.914033085150077, 0.0, 0.0, -0.6741162464751493)
UNALLOCATED_WEIGHTS = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -0.4618430079555811,
                       -1.256104553199527, -1.195438852921516, -14.16968643915636,
                       -1.45820701479218, 2.184967851601264, 0.6592857648113551,
                       1.208506246240294, 5.784062616707228, 0.0, 0.0, -0.7175860086678946)

# --- fixed values: file-type classes of the byte-statistics classifier (0 = UNKNOWN) ---
FILE_TYPE_CLASSES = ("UNKNOWN", "txt", "csv", "log", "html", "xml", "json", "js", "java", "css",
                     "b64", "a85", "b16", "url", "ps", "rtf", "tbird", "pst", "png", "gif", "tif",
                     "jb2", "gz", "zip", "bz2", "pdf", "docx", "xlsx", "pptx", "jpg", "mp3", "m4a",
                     "mp4", "avi", "wmv", "flv", "swf", "wav", "mov", "doc", "xls", "ppt", "fat",
                     "ntfs", "ext3", "exe", "dll", "elf", "bmp")

# --- fixed values: metadata field renames after flattening ---
FIELD_RENAMES = {"name-name": "name", "meta-mtime": "modified", "meta-crtime": "created",
                 "meta-atime": "accessed", "meta-size": "size"}

# --- fixed values: SOM defaults (code defaults) and region colouring ---
SOM_DEFAULTS = dict(random_seed=17, doc_freq_threshold_high=0.66, doc_freq_threshold_low=1e-4,
                    min_som_term_length=3, max_vector_features=5000, som_width=50, som_height=50,
                    max_neighbor_radius=30, min_neighbor_radius=1, max_alpha=0.05, min_alpha=0.01,
                    num_som_iterations=5, num_top_cell_terms=20)
NUM_REGION_COLORS = 9

HIGHLIGHT_OPEN = '<span class="secondarycolorbg">'
HIGHLIGHT_CLOSE = "</span>"

# Code points of scripts that are written without spaces. Every
# ideograph and hiragana is a token of its own; runs of katakana, and of Thai,
# Lao, Myanmar and Khmer letters, are one token.
SINGLE_RANGES = [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3041, 0x3096), (0x309D, 0x309F),
                 (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
KATAKANA_RANGES = [(0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]
RUN_RANGES = [(0x0E01, 0x0E3A), (0x0E40, 0x0E4E), (0x0E81, 0x0ECE), (0x1000, 0x103F), (0x1050, 0x108F), (0x1780, 0x17DD)]
# A longer token is no term, though it holds its position.
MAX_TOKEN_LENGTH = 255
