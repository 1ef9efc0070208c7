"""Column specifications and fixed values.

FIXED VALUES: the lists, ranges, domains, thresholds and texts below must equal
the behaviour being reproduced for results to match; they are stated plainly, in
natural order, and used unchanged by the operators.  Column names are the
snake_case names of the student table (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- FIXED VALUES: student table ------------------------------------------------

# Integer columns coerced by type repair, in order.
INT_COLUMNS = [
    "age", "grade", "ses_quartile", "internet_access", "extracurricular",
    "part_time_job", "parent_support", "romantic", "free_time", "go_out",
]

# Inclusive valid ranges clipped by range repair, in order.
RANGES = {
    "age": (14, 18),
    "grade": (9, 12),
    "ses_quartile": (1, 4),
    "attendance_rate": (0.0, 1.0),
    "study_hours": (0.0, 4.0),
    "internet_access": (0, 1),
    "extracurricular": (0, 1),
    "part_time_job": (0, 1),
    "parent_support": (0, 1),
    "romantic": (0, 1),
    "free_time": (1, 5),
    "go_out": (1, 5),
    "gpa": (0.0, 4.0),
}

# Valid categorical domains; the first value is the fallback when no mode exists.
DOMAINS = {
    "parental_education": ["<HS", "HS", "SomeCollege", "Bachelors+"],
    "school_type": ["Public", "Private"],
    "locale": ["Suburban", "City", "Rural", "Town"],
}

# Model input features, in the allow-list order.
CLEAN_FEATURES = [
    "attendance_rate", "study_hours", "internet_access", "extracurricular",
    "part_time_job", "parent_support", "romantic", "free_time", "go_out",
    "ses_quartile", "parental_education", "school_type", "locale", "age", "grade",
]

# Rows missing any of these are dropped (only those present are checked).
CRITICAL_COLUMNS = ["gpa", "attendance_rate", "study_hours"] + CLEAN_FEATURES

TARGET = "pass_fail"
SCORE_COLUMNS = ["test_math", "test_reading", "test_science"]
LEAKAGE_COLUMNS = ["gpa"] + SCORE_COLUMNS
PROTECTED_COLUMNS = ["gender", "race"]
AVG_SCORE = "avg_test_score"

CATEGORICAL_FEATURES = ["parental_education", "school_type", "locale"]
NUMERIC_FEATURES = [c for c in CLEAN_FEATURES if c not in CATEGORICAL_FEATURES]

# Label rule and profile thresholds.
GPA_THRESHOLD = 2.0
AVG_SCORE_THRESHOLD = 73.0
ATTENDANCE_THRESHOLD = 0.85
THRESHOLDS = {"gpa": GPA_THRESHOLD, AVG_SCORE: AVG_SCORE_THRESHOLD,
              "attendance_rate": ATTENDANCE_THRESHOLD}

# Failed-condition rules (applied to predicted label 0).
ATTENDANCE_FAIL_BELOW = 0.85
STUDY_FAIL_BELOW = 2.0
GPA_RISK_ATTENDANCE_BELOW = 0.80
GPA_RISK_STUDY_BELOW = 1.5

# Head limits per split after cleaning.
HEAD_LIMITS = {"train": 1_000_000, "validation": 100_000, "test": 300_000}
PROBE_ROWS = 5_000
SCATTER_ROWS = 50_000
SEED = 42
HIST_BINS = 50
KDE_GRIDSIZE = 200
KDE_CUT = 3.0
TOP_FACTORS = 3
PROB_THRESHOLD = 0.5

# Request contract: field -> (type, lower, upper); None bounds are unchecked.
CONTRACT_FIELDS = {
    "age": ("int", 14, 18),
    "grade": ("int", 9, 12),
    "ses_quartile": ("int", 1, 4),
    "parental_education": ("str", None, None),
    "school_type": ("str", None, None),
    "locale": ("str", None, None),
    "attendance_rate": ("float", 0.0, 1.0),
    "study_hours": ("float", 0.0, 4.0),
    "internet_access": ("int", 0, 1),
    "extracurricular": ("int", 0, 1),
    "part_time_job": ("int", 0, 1),
    "parent_support": ("int", 0, 1),
    "romantic": ("int", 0, 1),
    "free_time": ("int", 1, 5),
    "go_out": ("int", 1, 5),
}
OPTIONAL_CONTRACT_FIELDS = {"actual_gpa": ("float", 0.0, 4.0)}

# Benchmark run record columns and their rounding digits (None = not rounded).
RUN_METRIC_COLUMNS = {
    "label": None, "timestamp": None, "n_requests": None, "n_errors": None,
    "error_rate": 4, "total_execution_time_sec": 3, "total_execution_time_ms": 2,
    "min_latency_ms": 3, "avg_latency_ms": 3, "median_latency_ms": 3,
    "p50_latency_ms": 3, "p95_latency_ms": 3, "p99_latency_ms": 3,
    "max_latency_ms": 3, "throughput_req_per_sec": 2, "accuracy": 4,
    "success_rate": 4, "reliability_percent": 2,
}
# Metrics where a difference is in percentage points rather than percent.
POINT_METRICS = ["accuracy", "success_rate", "error_rate", "reliability_percent"]
ACCURACY_EQUIVALENCE = 0.001
ROLLING_WINDOW = 100

# --- FIXED VALUES: guidance texts ----------------------------------------------

RECOMMENDATION_KEYS = ["priority", "category", "action", "reason", "timeline"]
DEFAULT_SUMMARY = "Focus on improving the areas identified above."
FALLBACK_INVALID_JSON = {
    "priority": 1, "category": "General",
    "action": "Review your study habits and attendance patterns",
    "reason": "Improving these fundamental areas will have the greatest impact",
    "timeline": "2-4 weeks",
    "summary": "Focus on consistent attendance and dedicated study time.",
}
FALLBACK_OTHER = {
    "priority": 1, "category": "General",
    "action": "Consult with your academic advisor for personalized guidance",
    "reason": "Professional guidance can help identify specific improvement areas",
    "timeline": "Immediate",
    "summary": "Seek support from academic advisors and teachers.",
}
CONDITION_TEXTS = {
    "gpa": "GPA is below 2.0 threshold",
    "test_score": "Average test score is below 73 threshold",
    "attendance": "Attendance rate is below 85% threshold",
}
NO_CONDITION_TEXT = "General academic improvement needed"
CONDITION_HEADER = "Areas needing improvement:\n- "
FACTOR_HEADER = "\nModel explanation (top contributing factors):"
IMPACT_POSITIVE = "Increases pass probability"
IMPACT_NEGATIVE = "Decreases pass probability"
AT_RISK_MAX_TOKENS = 800
GOOD_STANDING_MAX_TOKENS = 600
TEMPERATURE = 0.7

# --- nested result types -------------------------------------------------------

RECOMMENDATION = T.StructType([
    T.StructField("priority", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("timeline", T.StringType()),
])
GUIDANCE = T.StructType([
    T.StructField("recommendations", T.ArrayType(RECOMMENDATION)),
    T.StructField("summary", T.StringType()),
])
ATTRIBUTION = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("impact", T.DoubleType()),
    T.StructField("direction", T.StringType()),
    T.StructField("description", T.StringType()),
])

# --- FIXED VALUES: prompt templates ----------------------------------------------
# Placeholders in braces are filled per row; every other character is literal.

AT_RISK_SYSTEM = """You are an expert academic advisor helping at-risk students improve their academic performance.
Your role is to analyze student profiles and provide personalized, actionable recommendations.

Guidelines:
1. Be encouraging and supportive - focus on what students CAN do
2. Provide specific, actionable steps (not vague advice)
3. Prioritize recommendations (most impactful first)
4. Consider the student's context (age, grade, resources available)
5. Be realistic about timelines
6. Focus on areas where the student is struggling

Always structure your response as a JSON object with this format:
{
    "recommendations": [
        {
            "priority": 1,
            "category": "Attendance|TestScore|GPA|General",
            "action": "Specific actionable step",
            "reason": "Why this helps",
            "timeline": "Expected timeline for improvement"
        }
    ],
    "summary": "Brief encouraging summary"
}

Provide 3-5 recommendations, prioritized by impact."""

GOOD_STANDING_SYSTEM = """You are an expert academic advisor helping successful students maintain and excel in their academic performance.
Your role is to analyze student profiles and provide personalized, encouraging guidance for continued success.

Guidelines:
1. Be positive and celebratory - acknowledge their current success
2. Provide specific, actionable steps for maintaining excellence and growth
3. Focus on prevention - help them avoid common pitfalls
4. Suggest opportunities for further growth and excellence
5. Consider their context (age, grade, resources available)
6. Keep recommendations concise and encouraging

Always structure your response as a JSON object with this format:
{
    "recommendations": [
        {
            "priority": 1,
            "category": "Maintenance|Growth|Prevention|General",
            "action": "Specific actionable step",
            "reason": "Why this helps maintain/excel",
            "timeline": "When to implement this"
        }
    ],
    "summary": "Brief encouraging summary celebrating their success"
}

Provide 2-4 concise recommendations focused on maintenance and growth."""

PROFILE_BLOCK = """Student Profile:
- Age: {age}, Grade: {grade}
- Attendance Rate: {attendance_pct}% ({attendance_note})
- Study Hours per day: {study_hours} hours
- Extracurricular Activities: {extracurricular}
- Part-time Job: {part_time_job}
- Parent Support: {parent_support}
- Internet Access: {internet_access}
- Free Time Level: {free_time}/5
- Social Activity Level: {go_out}/5
- Parental Education: {parental_education}
- School Type: {school_type}
- Location: {locale}
- Socioeconomic Status: Quartile {ses_quartile}/4"""

AT_RISK_TEMPLATE = """Analyze this at-risk student's profile and provide personalized guidance:

{profile}

{conditions}
{factors}

Provide personalized recommendations that:
1. Address the specific areas where the student is struggling
2. Are realistic given their circumstances
3. Include actionable steps they can take immediately
4. Consider their available resources (internet, parent support, etc.)

Return your response as a valid JSON object following the format specified in the system prompt."""

GOOD_STANDING_TEMPLATE = """Analyze this successful student's profile and provide personalized encouragement and growth guidance:

{profile}

{factors}

This student is currently in good academic standing (GPA >= 2.0 and Average Test Score >= 73).

Provide personalized guidance that:
1. Celebrates their current success and strengths
2. Offers specific tips to maintain their excellent performance
3. Suggests opportunities for further growth and excellence
4. Warns about common pitfalls that successful students might face
5. Is encouraging and motivating

Return your response as a valid JSON object following the format specified in the system prompt."""

AT_RISK_ATTENDANCE_NOTE = "Target: 85%"
GOOD_STANDING_ATTENDANCE_NOTE = "Excellent: above 85%"

# --- FIXED VALUES: raw CSV names and missing-value spellings ------------------------

# Raw CSV header -> our column name.
RAW_COLUMN_NAMES = {
    "Age": "age", "Grade": "grade", "Gender": "gender", "Race": "race",
    "SES_Quartile": "ses_quartile", "ParentalEducation": "parental_education",
    "SchoolType": "school_type", "Locale": "locale", "AttendanceRate": "attendance_rate",
    "StudyHours": "study_hours", "InternetAccess": "internet_access",
    "Extracurricular": "extracurricular", "PartTimeJob": "part_time_job",
    "ParentSupport": "parent_support", "Romantic": "romantic", "FreeTime": "free_time",
    "GoOut": "go_out", "GPA": "gpa", "TestScore_Math": "test_math",
    "TestScore_Reading": "test_reading", "TestScore_Science": "test_science",
}
# Double-typed raw columns (others are integers handled by type repair, or text).
RAW_DOUBLE_COLUMNS = ["attendance_rate", "study_hours", "gpa", "test_math", "test_reading",
                      "test_science"]
# Text spellings read as missing by the default CSV reader being matched [public API].
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                  "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                  "nan", "null"]
SPLITS = ["train", "validation", "test"]
