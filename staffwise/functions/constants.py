"""Fixed values.

Everything in this module is a fixed value that must equal the behaviour the
engine reproduces (file contracts, category names, keyword patterns, alias
spellings, tenure brackets, date formats). They are stated plainly, in their
natural order, and are not derived from anything.
"""

# --- fixed values: expected file columns, in contract order ---------------
HEADCOUNT_COLUMNS = ["Project", "Headcount"]

LEAVER_COLUMNS = [
    "Employee ID",
    "Employee Name",
    "Project",
    "Department",
    "Position",
    "Date of Joining",
    "Date of Leaving",
    "Length of Service",
    "Status",
    "Reason",
]

# --- fixed values: category taxonomy for reason labels, in list order -----
CATEGORIES = [
    "Better Career Opportunity",
    "Compensation & Benefits",
    "Personal Reasons",
    "Family Reasons",
    "Relocation",
    "Health Reasons",
    "Education",
    "Supervisor / Management Issue",
    "Working Environment",
    "Workload",
    "Attendance / Discipline",
    "Termination",
    "Contract Completion",
    "Left Without Information",
    "Other",
]

# --- fixed values: reason texts that mean "no reason" ---------------------
EMPTY_REASONS = ["not specified", "none", "n/a", "other"]

# --- fixed values: ordered keyword rules (first match wins) ---------------
REASON_RULES = [
    ("Left Without Notice",
     r"\blwn\b|left without notice|left without information|absconded|abscond|awol"
     r"|abandoned post|no show|disappeared|left without warning"),
    ("Compensation & Benefits",
     r"salary|package|pay|increment|money|compensation|benefit|bonus|wage"),
    ("Better Career Opportunity",
     r"opportunity|job|career|grow|better prospects|new role|hired|join|offer|promotion|future"),
    ("Family Reasons",
     r"family|marriage|child|parent|home|domestic|husband|wife|wedding|spouse|pregnant|maternity"),
    ("Health Reasons",
     r"health|sick|medical|illness|disease|treatment|accident|physical|mental|therapy|doctor"),
    ("Education",
     r"study|education|studies|higher|college|university|degree|course|exam"),
    ("Relocation",
     r"relocat|abroad|country|move|moving|shift|transfer|visa|travel"),
    ("Supervisor / Management Issue",
     r"supervisor|manager|boss|behavior|attitude|management|conflict|treatment|harass|rude|colleague"),
    ("Working Environment",
     r"environment|culture|politics|toxic|atmosphere|office|distance|commute|commuting"),
    ("Workload",
     r"workload|pressure|stress|hours|night shift|shift timing|overtime|burnout|exhaust"),
    ("Attendance / Discipline",
     r"discipline|absent|attendance|violation|policy|misconduct|warning"),
    ("Termination",
     r"terminate|fire|fired|dismiss|layoff|laid off|redundant"),
    ("Contract Completion",
     r"contract|expire|completion|complete|period|end date|project end"),
    ("Personal Reasons", r"personal"),
]
RULE_DEFAULT = "Other"

# --- fixed values: alias spellings (lower-case key -> canonical) ----------
ALIASES = [
    ("hr", "Human Resources"),
    ("human resource", "Human Resources"),
    ("hr dept", "Human Resources"),
    ("hr depart", "Human Resources"),
    ("admin", "Administration"),
    ("acct", "Accounts"),
    ("account", "Accounts"),
    ("it", "Information Technology"),
    ("house keeping", "Housekeeping"),
    ("chines & thai", "Chinese & Thai"),
    ("front desk", "Front Office"),
]

# --- fixed values: fuzzy matching cutoff and minimum prefix length --------
FUZZY_CUTOFF = 0.78
PREFIX_MIN_LEN = 4

# --- fixed values: tenure brackets (ordinal, label, implication) ----------
BRACKETS = [
    (1, "< 3 Months", "Onboarding failure risk"),
    (2, "3 - 6 Months", "Early disengagement"),
    (3, "6 - 12 Months", "Role misalignment"),
    (4, "1 - 2 Years", "Growth / career path gap"),
    (5, "> 2 Years", "Experienced talent loss"),
]
UNKNOWN_BRACKET = (6, "Unknown", None)
BRACKET_LIMITS = [3, 6, 12, 24]  # months below which brackets 1 to 4 hold
# what surrounds a model's label: quotes, dashes, blanks, and final stops
LABEL_WRAPPING = r"""^['"\-\s]+|['"\-\s.]+$"""
EARLY_SERVICE_MONTHS = 6.0

# --- fixed values: accepted date spellings, tried in this order -----------
# (Spark pattern, DuckDB strptime pattern)
DATE_FORMATS = [
    ("yyyy-M-d", "%Y-%m-%d"),
    ("d/M/yyyy", "%d/%m/%Y"),
    ("M/d/yyyy", "%m/%d/%Y"),
    ("yyyy/M/d", "%Y/%m/%d"),
    ("d-M-yyyy", "%d-%m-%Y"),
]

# --- fixed values: days per month for service length ----------------------
DAYS_PER_MONTH = 30.4375
SERVICE_TOLERANCE_MONTHS = 1.5

# --- fixed values: month pattern in file names ----------------------------
FILENAME_MONTH_PATTERN = r"(\d{4})[-_](\d{2})"

# --- fixed values: decimal text accepted as a number ----------------------
NUMBER_PATTERN = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# --- fixed values: status / category words -------------------------------
TERMINATED_STATUS = "terminated"
DEFAULT_STATUS = "Resigned"
DEFAULT_REASON = "Not Specified"
TERMINATION_PATTERN = "terminat|dismiss|discharg"
TERMINATION_CATEGORIES = ["Termination", "Attendance / Discipline"]

# --- fixed values: risk and alert thresholds ------------------------------
DEPT_RISK_HIGH = 25.0
DEPT_RISK_MEDIUM = 10.0
MONTHLY_ALERT_RATE = 5.0
RATE_BANDS = [(0.0, 10.0, "0-10"), (10.0, 20.0, "10-20"), (20.0, 30.0, "20-30")]

# --- fixed values: issue messages ('{}' is filled with the cell value) ----
MSG_FILENAME_NO_MONTH = ("Could not extract month (YYYY-MM) from filename '{}'. Please ensure file "
                         "name contains year and month (e.g., headcount_2026_06.xlsx).")
MSG_FILENAME_BAD_MONTH = "Invalid month extracted: {} from file {}"
MSG_MISSING_COLUMNS = "Missing expected columns: {}"
MSG_PROJECT_EMPTY = "Project name cannot be empty."
MSG_HEADCOUNT_NULL = "Headcount cannot be null."
MSG_HEADCOUNT_NOT_INT = "Headcount must be a non-negative integer. Found: {}"
MSG_HEADCOUNT_NAN = "Headcount must be a number. Found: {}"
MSG_ID_EMPTY = "Employee ID cannot be empty."
MSG_ID_DUPLICATE = "Duplicate Employee ID within file: {}"
MSG_ID_EXISTS = "Employee ID {} already exists in DB. Importing will update the record."
MSG_REQUIRED = "{} cannot be empty."
MSG_DATE_MISSING = "{} is missing."
MSG_DATE_UNPARSED = "Could not parse {} as date. Recommended format: YYYY-MM-DD"
MSG_DATE_ORDER = "Date of Leaving cannot be before Date of Joining."
MSG_SERVICE_EMPTY = "Length of Service is empty. It will be auto-calculated."
MSG_SERVICE_NEGATIVE = "Length of Service cannot be negative."
MSG_SERVICE_MISMATCH = "Reported service length significantly differs from date interval."
MSG_SERVICE_NAN = "Length of Service must be a number. Found: {}"
MSG_REASON_EMPTY = "Resignation reason is empty."
MSG_UNRECOGNIZED_HC_PROJECT = ("Unrecognized Project '{}'. Please correct the Excel file, or add this "
                               "project to System Configurations.")
MSG_UNRECOGNIZED = "Unrecognized {} '{}'. Please correct or add to System Standards."
MSG_AUTOCORRECTED = "Auto-corrected to '{}'"
