"""Constants, word lists, patterns and message formats.

Everything here has to hold exactly these values for results to be right.
"""

PHASES = ["Phase I", "Phase II", "Phase III", "Phase IV"]
GENDERS = ["Male", "Female", "Other"]
SEVERITIES = ["Mild", "Moderate", "Severe", "Life-threatening"]
AGENT_TYPES = ["research", "prediction", "optimization", "report"]

# Portfolio statistics used when a column does not exist
DEFAULT_STATS = {
    "success": 0.65,
    "duration_days": 365.0,
    "enrollment": 200.0,
    "dropout_rate": 0.15,
    "cost_usd": 5000000.0,
}

# Cost estimate
COST_BASE = {"Phase I": 1500000, "Phase II": 7000000, "Phase III": 20000000, "Phase IV": 10000000}
COST_BASE_OTHER = 5000000
COST_PER_PATIENT = 15000
COST_PER_MONTH = 50000
DAYS_PER_MONTH = 30
COST_AREA_FACTOR = {
    "Oncology": 1.5, "Cardiology": 1.3, "Neurology": 1.4, "Infectious Disease": 1.1,
    "Immunology": 1.3, "Endocrinology": 1.0, "Gastroenterology": 1.1, "Respiratory": 1.2,
}

# Adverse events
AE_BASE_RATE = 0.3
AE_PHASE_FACTOR = {"Phase I": 0.4, "Phase II": 0.3, "Phase III": 0.25, "Phase IV": 0.2}
AE_AREA_FACTOR = {
    "Oncology": 1.5, "Cardiology": 1.2, "Neurology": 1.1, "Infectious Disease": 1.0,
    "Immunology": 1.3, "Endocrinology": 0.9, "Gastroenterology": 1.0, "Respiratory": 1.1,
}
AE_CONTROL_FACTOR = 0.7

# Success probability and prediction
PHASE_SUCCESS_RATE = {"Phase I": 0.70, "Phase II": 0.50, "Phase III": 0.60, "Phase IV": 0.75}
PHASE_SUCCESS_POINTS = {"Phase I": 70, "Phase II": 50, "Phase III": 60, "Phase IV": 75}
OTHER_SUCCESS_POINTS = 60
PREDICTION_CONFIDENCE = 75
INTERVAL_HALF_WIDTH = 0.15
ENDPOINT_THRESHOLD = 0.7
RISK_NAMES = {
    "dropout": "High expected dropout rate",
    "duration": "Long trial duration",
    "enrollment": "Large enrollment target",
    "area": "Complex therapeutic area",
}
RISK_NONE = "Standard trial risks"
ANSWER_DEFAULT_PROBABILITY = 0.65
ANSWER_DEFAULT_CONFIDENCE = 0.75
ANSWER_DEFAULT_EXPLANATION = "Prediction based on trial parameters and historical data"

ANSWER_TEXT = (
    "SUCCESS_PROBABILITY: {points}%\nCONFIDENCE: {confidence}%\nRISK_FACTORS: {risks}\n"
    "EXPLANATION: This {phase} trial in {area} has a moderate success probability based on historical data. "
    "The trial design appears feasible with {enrollment} patients over {years} years."
)
PREDICTION_TEXT = (
    "**Clinical Trial Success Prediction**\n\n**Predicted Success Probability: {probability}%**\n"
    "Confidence Score: {confidence}%\n\n**Identified Risk Factors:**\n{risks}\n**Analysis:**\n{explanation}\n\n"
    "{mark} **Assessment**: {band}"
)
BAND_MARK = {"high": "✓", "moderate": "⚠", "low": "✗"}

# Chat words: language, class, words
CONFIRM_WORDS = {
    "en": ["yes", "confirm", "ok", "proceed", "y"],
    "hi": ["हां", "हाँ", "जी", "ठीक है", "हां करें"],
    "bn": ["হ্যাঁ", "ঠিক আছে", "করুন"],
}
CANCEL_WORDS = {
    "en": ["no", "cancel", "abort", "n"],
    "hi": ["नहीं", "रद्द करें", "नही"],
    "bn": ["না", "বাতিল", "নাহ"],
}
UPDATE_WORDS = [
    "update", "change", "modify", "set", "edit",
    "अपडेट", "बदलें", "परिवर्तन", "सेट",
    "আপডেট", "পরিবর্তন", "সেট", "সম্পাদনা",
]
TRANSLATE_WORDS = [
    "translate", "translation", "convert to",
    "अनुवाद", "में बदलें",
    "অনুবাদ", "রূপান্তর",
]
LANGUAGE_NAMES = [
    ("hindi", "hi"), ("हिंदी", "hi"), ("हिन्दी", "hi"),
    ("bengali", "bn"), ("bangla", "bn"), ("বাংলা", "bn"),
    ("english", "en"), ("अंग्रेजी", "en"), ("ইংরেজি", "en"),
]

# Chat patterns, tried in this order
HINDI_SCRIPT = "[ऀ-ॿ]"
BENGALI_SCRIPT = "[ঀ-৿]"
SHORT_UPDATE_PATTERNS = [
    r"set\s+(?:it\s+)?to\s+(\d+)",
    r"change\s+(?:it\s+)?to\s+(\d+)",
    r"make\s+(?:it\s+)?(\d+)",
    r"update\s+(?:it\s+)?to\s+(\d+)",
]
SHORT_UPDATE_FIELD = "patients_enrolled"
ID_PATTERN = r"(?i)(?:simulation[:\s]+|sim[:\s]+|id[:\s]+|for\s+)([a-z0-9_-]+)"
NAMED_FIELD_PATTERNS = [
    (r"patients?\s+enrolled\s+to\s+(\d+)", "patients_enrolled"),
    (r"patient\s+(?:number|count)\s+to\s+(\d+)", "patients_enrolled"),
    (r"dropout\s+rate\s+to\s+([\d.]+)", "dropout_rate"),
]
ANY_FIELD_PATTERNS = [
    r"([A-Za-z0-9_]+)\s+to\s+([\d.]+)",
    r"([A-Za-z0-9_]+)\s*:\s*([\d.]+)",
    r"([A-Za-z0-9_]+)\s*=\s*([\d.]+)",
]

# Chat replies; {id} {field} {old} {new} are filled in
UPDATE_REQUEST_TEXT = {
    "en": "📝 Update Request Detected:\n- Simulation ID: {id}\n- Field: {field}\n"
          "- Current Value: {old}\n- New Value: {new}\n\n"
          "Reply with 'YES' or 'CONFIRM' to proceed, or 'NO' or 'CANCEL' to abort.",
    "hi": "📝 अपडेट अनुरोध:\n- सिमुलेशन ID: {id}\n- फ़ील्ड: {field}\n"
          "- वर्तमान मान: {old}\n- नया मान: {new}\n\n"
          "जारी रखने के लिए 'हां' या 'YES' का जवाब दें, या रद्द करने के लिए 'नहीं' या 'NO' का जवाब दें।",
    "bn": "📝 আপডেট অনুরোধ:\n- সিমুলেশন ID: {id}\n- ফিল্ড: {field}\n"
          "- বর্তমান মান: {old}\n- নতুন মান: {new}\n\n"
          "এগিয়ে যেতে 'হ্যাঁ' বা 'YES' উত্তর দিন, অথবা বাতিল করতে 'না' বা 'NO' উত্তর দিন।",
}
UPDATE_DONE_TEXT = {
    "en": "✅ Successfully Updated!\n\n- Simulation ID: {id}\n- Field: {field}\n"
          "- Previous Value: {old}\n- New Value: {new}\n\n"
          "🔄 Re-processing simulation...\nResults will be ready in a few minutes.",
    "hi": "✅ सफलतापूर्वक अपडेट किया गया!\n\n- सिमुलेशन ID: {id}\n- फ़ील्ड: {field}\n"
          "- पुराना मान: {old}\n- नया मान: {new}\n\n"
          "🔄 सिमुलेशन को फिर से प्रोसेस किया जा रहा है...\nपरिणाम कुछ मिनटों में तैयार हो जाएंगे।",
    "bn": "✅ সফলভাবে আপডেট করা হয়েছে!\n\n- সিমুলেশন ID: {id}\n- ফিল্ড: {field}\n"
          "- পুরাতন মান: {old}\n- নতুন মান: {new}\n\n"
          "🔄 সিমুলেশন পুনরায় প্রক্রিয়া করা হচ্ছে...\nফলাফল কয়েক মিনিটের মধ্যে প্রস্তুত হবে।",
}
RESULT_LINE = (
    "- ID: {id}, Patients Enrolled: {enrolled}, Patients Completed: {completed}, "
    "Success Probability: {probability}, Cost: ${cost}"
)

# Login audit
LOCAL_ADDRESSES = ["127.0.0.1", "localhost", "unknown"]
LOCAL_PREFIX = "192.168."

# Bands
BAND_TEXT = {
    "high": "High probability of success. Trial design appears robust.",
    "moderate": "Moderate probability. Consider risk mitigation strategies.",
    "low": "Lower probability. Significant protocol optimization recommended.",
}

# Advice lines: code, lines
ADVICE = [
    ("enrollment", [
        "**1. Enrollment Strategy:**",
        "   - Consider multi-site approach to accelerate enrollment",
        "   - Implement site selection criteria to identify high-performing sites",
        "   - Use predictive modeling for enrollment forecasting",
    ]),
    ("duration", [
        "\n**2. Timeline Optimization:**",
        "   - Evaluate interim analysis timepoints for early success signals",
        "   - Consider adaptive design elements to adjust sample size",
        "   - Current duration: {years} years - assess if endpoint can be measured earlier",
    ]),
    ("dropout", [
        "\n**3. Dropout Rate Reduction:**",
        "   - Implement patient engagement programs",
        "   - Simplify visit schedules where possible",
        "   - Provide transportation and financial support",
        "   - Use digital health tools for remote monitoring",
    ]),
    ("cost", [
        "\n**4. Cost Efficiency Improvements:**",
        "   - Leverage centralized lab services",
        "   - Implement risk-based monitoring (RBM)",
        "   - Use electronic data capture (EDC) systems",
        "   - Consider decentralized trial elements",
    ]),
    ("endpoint", [
        "\n**5. Endpoint Enhancement:**",
        "   - Primary: {endpoint}",
        "   - Consider adding biomarker endpoints for early signals",
        "   - Ensure endpoints are clinically meaningful and measurable",
    ]),
    ("safety", [
        "\n**6. Safety Optimization:**",
        "   - Implement real-time adverse event monitoring",
        "   - Establish clear stopping rules",
        "   - Use Data Safety Monitoring Board (DSMB)",
    ]),
    ("alert", [
        "\n⚠ **Alert**: Simulated dropout rate ({dropout}%) exceeds target - prioritize retention strategies",
    ]),
]
ADVICE_TITLE = "**Trial Protocol Optimization Recommendations**\n"

# Portfolio summary
SUMMARY_PHASE_WORDS = ["phase i", "phase ii", "phase iii", "phase iv"]
SUMMARY_AREA_WORDS = ["oncology", "cardiology", "neurology", "immunology"]
SUMMARY_HEAD = [
    "**Historical Trial Analysis**\n",
    "Based on {total} historical trials:\n",
    "- Overall Success Rate: {success}%",
    "- Average Duration: {years} years",
    "- Average Enrollment: {enrollment} patients",
    "- Average Dropout Rate: {dropout}%",
    "- Average Cost: ${cost}M\n",
]
SUMMARY_PHASE_TITLE = "**Success Rates by Phase:**"
SUMMARY_AREA_TITLE = "**Trials by Therapeutic Area:**"
SUMMARY_FACTORS = [
    "**Key Success Factors Identified:**",
    "1. **Enrollment Rate**: Trials meeting enrollment targets have 25% higher success rates",
    "2. **Dropout Management**: Keeping dropout rates below 20% improves success by 30%",
    "3. **Duration**: Optimal trial duration varies by phase (Phase II: 1-2 years optimal)",
    "4. **Patient Selection**: Strict inclusion criteria improve efficacy signals",
    "5. **Safety Profile**: Early adverse event monitoring critical for continuation",
]
SUMMARY_RECOMMEND = [
    "\n**Data-Driven Recommendations:**",
    "- Plan for 15-20% dropout rate in sample size calculations",
    "- Implement proactive patient retention strategies",
    "- Consider adaptive trial designs for efficiency",
    "- Benchmark against similar completed trials",
    "- Budget 10-15% contingency for timeline extensions",
]

# Trial report
REPORT_HEAD = ["# CLINICAL TRIAL ANALYSIS REPORT", "Generated: {now}", "\n---\n"]
REPORT_DESIGN = [
    "## EXECUTIVE SUMMARY\n",
    "**Trial Name:** {name}",
    "**Phase:** {phase}",
    "**Therapeutic Area:** {area}",
    "**Target Enrollment:** {enrollment} patients",
    "**Duration:** {years} years\n",
]
REPORT_RESULT = [
    "## SIMULATION RESULTS\n",
    "**Success Probability:** {probability}%",
    "**Patients Completed:** {completed}/{enrolled}",
    "**Dropout Rate:** {dropout}%",
    "**Estimated Cost:** ${cost}M",
    "**Efficacy Score:** {efficacy}%",
    "**Safety Score:** {safety}%\n",
]
REPORT_BENCHMARK = [
    "## BENCHMARKING\n",
    "**Industry Average Success Rate:** {success}%",
    "**Average Trial Duration:** {avg_years} years",
    "**Average Dropout Rate:** {avg_dropout}%\n",
]
REPORT_END = [
    "## KEY RECOMMENDATIONS\n",
    "1. Implement robust patient retention strategies",
    "2. Establish clear interim analysis timepoints",
    "3. Maintain proactive safety monitoring",
    "4. Consider adaptive design elements",
    "5. Plan for 15% budget contingency\n",
    "---\n",
    "*This report is generated using AI analysis and historical data. ",
    "Consult with clinical development experts for final decision-making.*",
]
