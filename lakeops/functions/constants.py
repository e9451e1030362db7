"""Fixed values the reports depend on. Plain data, no logic."""

# -- run status sets (compared in lower case); they differ per report on purpose
SUCCESS = ("completed", "succeeded")
FAILURE_METRICS = ("failed", "cancelled", "deduped")
FAILURE_ANALYSIS = ("failed", "cancelled")
IN_PROGRESS = ("inprogress", "running", "notstarted")

# -- health thresholds in percent
HEALTHY_PCT = 95
WARNING_PCT = 80

# -- item types that can change region without being rebuilt
MOVABLE_TYPES = (
    "Report", "SemanticModel", "Dashboard", "DataflowGen1", "Dataflow",
    "PaginatedReport", "Datamart", "Scorecard",
)

# -- item types that make a workspace hard to move
HIGH_COMPLEXITY_TYPES = (
    "Notebook", "DataPipeline", "Eventhouse", "KQLDatabase", "SparkJobDefinition",
    "Eventstream", "MLExperiment", "MLModel", "Environment", "KQLQueryset",
    "KQLDashboard", "GraphQLApi", "MirroredDatabase", "MirroredWarehouse", "Reflex",
    "DataflowGen2", "CopyJob", "ApacheAirflowJob",
)

# -- item types that need a data copy
MEDIUM_COMPLEXITY_TYPES = ("Lakehouse", "Warehouse", "SQLEndpoint", "SQLDatabase")

WAVES = {"Low": 1, "Medium": 2, "High": 3}
PRIORITIES = {"Critical": 0, "High": 1, "Medium": 2, "Info": 3}

# -- byte units; style A goes to EB, style B stops at TB
UNITS_A = ("B", "KB", "MB", "GB", "TB", "PB", "EB")
UNITS_B = ("B", "KB", "MB", "GB", "TB")

# -- upper ends (inclusive) of the account revenue tiers; above the last: Strategic
REVENUE_TIERS = (("SMB", 50_000_000), ("MidMarket", 500_000_000), ("Enterprise", 5_000_000_000))

# -- sales rules
CLOSED_STAGES = ("ClosedWon", "ClosedLost")
QUALIFIED_SCORE = 70

# -- declared type name -> canonical type
TYPE_ALIASES = {
    "number": "Number", "int": "Number", "integer": "Number", "long": "Number",
    "decimal": "Number", "double": "Number", "float": "Number", "money": "Number",
    "text": "Text", "string": "Text", "varchar": "Text", "char": "Text",
    "date": "DateTime", "datetime": "DateTime", "timestamp": "DateTime",
    "bool": "Boolean", "boolean": "Boolean", "bit": "Boolean",
}

# -- sensitivity label -> priority
LABEL_PRIORITY = {
    "Public": 0, "Internal": 1, "Confidential-PII": 2, "Highly-Confidential-Restricted": 3,
}

# -- call budgets: (calls, seconds), warning and stop shares
ADMIN_BUDGET = (200, 3600)
GRAPH_BUDGET = (15, 5)
WARN_SHARE, STOP_SHARE = 0.80, 0.95

# -- diagnostic thresholds
SMALL_GROUP_ROWS = 102_400
LONG_QUERY_SECONDS = 300
COLD_CACHE_MB = 100
STRING_LIMIT = 4000
GIB = 1024 ** 3
