"""The prompts by task and caller, whole, with ``${name}`` where a value goes."""

# Prompts of queue tasks.
DESIGN_AGENT = """Design a complete enterprise network architecture for:
- Users/endpoints: ${users}
- Sites/locations: ${sites}
- Required compliance: ${compliance}
- Uptime requirement: ${uptime}% (${downtime})
- Budget: ${budget}

Provide topology selection rationale, redundancy design, routing protocol selection,
security architecture, and implementation roadmap. Include configuration examples.${extras}"""
DESIGN_AGENT_EXTRA = "\nAdditional requirement — ${key}: ${value}"

TROUBLESHOOT_AGENT = """Troubleshoot this network issue:

Device: ${device}
Symptom: ${symptom}
Protocol: ${protocol}
Impact: ${impact}
"""

ESTIMATE_AGENT = """Provide a detailed cost estimate for:

${context}

Break down CAPEX and annual OPEX. Include hardware, licensing, and implementation."""

# Prompts of service requests.
DESIGN_API = """Design a complete enterprise network architecture:
- Users/endpoints: ${users}
- Sites: ${sites}
- Compliance: ${compliance}
- Uptime SLA: ${uptime}%
- Budget: ${budget}
- Data center: ${data_center}
- WAN type: ${wan_type}
- Cloud connectivity: ${cloud_connectivity}
- Redundancy level: ${redundancy_level}
${extras}"""
DESIGN_API_EXTRA = "- ${key}: ${value}\n"

TROUBLESHOOT_API = """Troubleshoot: ${symptom}
Device: ${device}
Protocol: ${protocol}${logs}"""
TROUBLESHOOT_API_LOGS = "\nLogs:\n${logs}"

ESTIMATE_API = "Cost estimate for ${users} users, ${sites} sites, compliance=[${compliance}]"

# Prompts of tool calls.
DESIGN_TOOL = """Design a complete enterprise network architecture:
Users: ${users}
Sites: ${sites}
Compliance: ${compliance}
Uptime SLA: ${uptime}%
Budget: ${budget}
Data center needed: ${data_center}
Wireless coverage: ${wireless}

Provide: topology selection, routing design, redundancy, security segmentation,
hardware recommendations, and phased implementation plan."""

TROUBLESHOOT_TOOL = """Troubleshoot network design issue:
Device: ${device}
Symptom: ${symptom}
Protocol: ${protocol}
${logs}"""
TROUBLESHOOT_TOOL_LOGS = "\nRelevant logs:\n${logs}"

ESTIMATE_TOOL = """Provide detailed cost estimate (${currency}):
Users: ${users}, Sites: ${sites}
Compliance: ${compliance}
Include: CAPEX itemization, ${opex}hardware, licensing, implementation labor"""
ESTIMATE_TOOL_OPEX = "annual OPEX, "

# The form a judge fills in.
JUDGE = """## Evaluation Task

Rate this network architect AI response on a 1-5 scale.

**Question:** ${question}

**Response:** ${response}

**Scoring Rubric:**
- 5: Perfect - Structured <think> reasoning (8+ steps), every claim cited to a source, exact compliance version numbers (e.g., "PCI-DSS 4.0.1 §1.2"), vendor-validated configs, cost estimates grounded in data
- 4: Good - 5-7 reasoning steps, most claims sourced, compliance frameworks mentioned with versions
- 3: Adequate - 3-4 reasoning steps, general sources mentioned, compliance frameworks named
- 2: Weak - Minimal reasoning, few or no sources, generic compliance statements
- 1: Poor - No structured reasoning, unsupported claims, missing source attribution

**Required format:** JSON only: {"score": <1-5>, "rationale": "<25 words max>"}"""
