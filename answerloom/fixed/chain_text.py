"""The sentences of reasoning chains."""

# Step titles and their source lines.
SCALE_TITLE = "Network Scale Classification and Topology Selection"
SCALE_SOURCE = "Enterprise Network Design - Topology Selection Criteria, Chapter: Campus Design Hierarchy"
PCI_TITLE = "PCI-DSS 4.0.1 Network Requirements Analysis"
PCI_SOURCE = "PCI-DSS v4.0.1 - Requirements 1-4, Chapter: Network Segmentation and CDE Isolation"
HIPAA_TITLE = "HIPAA Security Rule Network Requirements"
HIPAA_SOURCE = "HIPAA Security Rule - 45 CFR Part 164, Chapter: Technical Safeguards for ePHI"
HA_SOURCE = "Network HA Design Patterns - Active-Active vs Active-Standby, Chapter: Redundancy Calculations"
WAN_TITLE = "WAN Architecture Selection"
WAN_SOURCE = "WAN Design Guide - Transport Selection Framework, Chapter: SD-WAN vs MPLS Decision Matrix"
SECURITY_TITLE = "Security Architecture Design"
SECURITY_SOURCE = "Zero Trust Architecture Guide, Chapter: Network Segmentation and Defense-in-Depth"
VENDOR_TITLE = "Technology Stack and Vendor Selection"
VENDOR_SOURCE = "Vendor Comparison Guide - Enterprise Networking Platforms, Chapter: Platform Selection by Scale"
COST_TITLE = "Cost Estimation Using Industry Benchmarks"
COST_SOURCE = "Enterprise Network TCO Model - CapEx/OpEx Benchmarks, Chapter: Cost Modeling by Organization Size"
PHASE_TITLE = "Implementation Phasing and Risk Mitigation"
PHASE_SOURCE = "Enterprise Migration Methodology - Phased Deployment Patterns, Chapter: Large-Scale Network Implementation"

# Compliance step bodies.
PCI_BODY = """- PCI-DSS 4.0.1 Section 1.2: All connections to CDE controlled by NSC
- PCI-DSS 4.0.1 Section 1.3: Prohibit direct public access between internet and CDE
- PCI-DSS 4.0.1 Section 4.2.1: TLS 1.2+ required for cardholder data in transit
- Scope: CDE VLAN isolated with dedicated firewall rules
- Logging: All CDE access logged per Requirement 10 (12-month retention)"""
PCI_SUB = [
    "CDE VLAN: VLAN 100 with dedicated ACL (permit-to-CDE, permit-from-CDE)",
    "Quarterly vulnerability scans by ASV required",
    "Annual penetration testing of CDE scope",
]
HIPAA_BODY = """- HIPAA §164.312(a)(1): Access control - unique user IDs, automatic logoff
- HIPAA §164.312(e)(1): Transmission security - guard against unauthorized access
- HIPAA §164.312(e)(2)(ii): Encryption of ePHI in transit (addressable)
- EHR/EMR systems: Separate VLAN with access controls
- Medical devices: Isolated VLAN (FDA-regulated devices)"""
HIPAA_SUB = [
    "PHI VLAN isolated from general network",
    "Encryption: TLS 1.2+ for all ePHI transmission",
    "Audit logging: All ePHI access logged",
]

# Availability.
UPTIME_NOTES = {
    "99.9%": "8.76 hours downtime/year → N+1 redundancy, HSRP/VRRP",
    "99.99%": "52.6 minutes downtime/year → N+1 with BFD, active-standby DC",
    "99.999%": "5.26 minutes downtime/year → N+2, active-active DC, full redundancy",
}
UPTIME_DEFAULT_NOTE = "Calculate max downtime/year"
UPTIME_TAIL = """- Redundancy strategy selected based on downtime tolerance
- BFD for sub-second failure detection at all critical links"""
HA_SUB = [
    "Core layer: N+1 redundancy (minimum)",
    "Distribution: dual-homed to core",
    "Access: dual uplinks to distribution pair",
]
HA_SUB_STRICT = [
    "No single point of failure across stack",
    "Geo-redundant DC with sub-second failover",
]

# WAN.
WAN_SUB = {
    "sd_wan": [
        "Primary transport: MPLS for latency-sensitive apps",
        "Secondary transport: Broadband internet for SaaS/cloud",
        "Application-aware routing: DPI-based traffic steering",
        "Zero-touch provisioning for new site deployment",
    ],
    "mpls": [
        "Dedicated MPLS circuit with guaranteed SLA",
        "QoS classes: EF (voice), AF41 (video), AF31 (business)",
        "Backup: internet IPSec VPN (failover only)",
    ],
}

# Security.
SECURITY_HEAD = "- Security model: Defense-in-depth with micro-segmentation"
SECURITY_TAIL = "- Zero Trust principles: verify explicitly, least privilege, assume breach"
SECURITY_SUB = [
    "Layer 1: Perimeter NGFW (stateful inspection + IPS)",
    "Layer 2: Network micro-segmentation (VLAN + firewall zones)",
    "Layer 3: Identity-based access (802.1X + NAC)",
    "Layer 4: Data encryption (TLS 1.3 in transit, AES-256 at rest)",
]
SECURITY_PCI = "PCI-DSS CDE: Isolated VLAN with dedicated firewall rules"
SECURITY_HIPAA = "HIPAA PHI: Encrypted storage, audit logging all access"

# Hardware by users above 10000, above 2000, other (core, distribution, access).
HARDWARE = [
    (10000, "Cisco Catalyst 9500-48Y4C (48x25G + 4x100G)",
     "Cisco Catalyst 9400 with dual supervisors", "Cisco Catalyst 9300 (StackWise, PoE)"),
    (2000, "Cisco Catalyst 9500-24Q or Arista 7050X", "Cisco Catalyst 9400 or Arista 7280R",
     "Cisco Catalyst 9200/9300"),
    (None, "Cisco Catalyst 9300 (collapsed core)", "N/A (collapsed core topology)",
     "Cisco Catalyst 9200"),
]
HARDWARE_TAIL = """- Firewall: Palo Alto PA-series (application-aware, NGFW)
- Wireless: Cisco Catalyst Center managed APs"""

# Rollout plans.
PHASES_LARGE = """- Phase 1 (Months 1-2): Core/distribution at primary and DR DC
- Phase 2 (Months 3-4): Site rollout in waves of 5 sites
- Phase 3 (Months 5-6): Compliance validation, user migration
- Total timeline: 6 months (standard for this scale)"""
PHASES_MEDIUM = """- Phase 1 (Weeks 1-4): Core infrastructure deployment
- Phase 2 (Weeks 5-10): Distribution and access layer
- Phase 3 (Weeks 11-16): Migration and validation
- Total timeline: 16 weeks"""
PHASES_SMALL = """- Phase 1 (Weeks 1-2): Core/access deployment
- Phase 2 (Weeks 3-4): WiFi, VPN, and services
- Phase 3 (Week 5): User migration
- Total timeline: 5 weeks"""

# Troubleshooting steps.
TRIAGE_TITLE = "Problem Classification and Initial Triage"
TRIAGE_SOURCE = "Network Troubleshooting Methodology - Problem Classification, Chapter: Systematic Diagnostic Approach"
TRIAGE_TAIL = "- Using OSI model bottom-up troubleshooting sequence"
LINK_TITLE = "Physical and Data Link Layer Verification"
LINK_SOURCE = "OSI Layer Troubleshooting Guide - Layer 1-2 Diagnostics, Chapter: Bottom-Up Systematic Verification"
LINK_BODY = """Verify physical and data link layer before higher-layer investigation:
- Check interface status: show interface brief
- Verify no input/output errors: show interface counters errors
- Confirm duplex/speed: no mismatch
- Check VLAN membership and trunk configuration"""
GENERIC_SOURCE = "Network Troubleshooting Methodology - Systematic Diagnosis, Chapter: Protocol-Specific Diagnostics"
GENERIC_TAIL = """- Check configuration consistency
- Verify neighbor/peer state
- Examine logs for error messages"""
RESOLUTION_TITLE = "Root Cause Analysis and Resolution"
RESOLUTION_SOURCE_TAIL = " Troubleshooting Decision Tree - Resolution Actions, Chapter: Configuration Corrections and Verification"
RESOLUTION_TAIL = """- Apply corrective configuration changes
- Verify resolution with show commands
- Monitor for recurrence"""
CAUSES = {
    "bgp": "AS number mismatch, TCP 179 blocked, MD5 auth mismatch, missing route to peer",
    "ospf": "MTU mismatch (most common), duplicate router-ID, area type mismatch, authentication",
    "interface": "Duplex mismatch, bad cable/SFP, QoS drops, ACL blocking traffic",
    "connectivity": "Routing table missing prefix, ACL deny, NAT failure, firewall rule",
}
CAUSE_DEFAULT = "Configuration mismatch or hardware failure"
VERIFY = {
    "bgp": [
        "show bgp summary (verify Established state)",
        "show ip bgp <prefix> (verify route in table)",
        "ping source loopback (verify data plane)",
    ],
    "ospf": [
        "show ip ospf neighbor (verify Full state)",
        "show ip route ospf (verify routes in table)",
        "show ip ospf database (verify LSA synchronization)",
    ],
    "interface": [
        "show interface <int> (verify up/up, zero errors)",
        "ping <destination> repeat 100 (verify no drops)",
        "show interface counters (monitor for new errors)",
    ],
}
VERIFY_DEFAULT = ["Verify issue resolved", "Monitor for recurrence"]

# How a diagnostic route words its steps (title prefix, source line).
ROUTE_WORDING = {
    "bgp": ("BGP Diagnostic: ",
            "BGP Troubleshooting Decision Tree - Cisco and RFC-based Diagnostic Methodology"),
    "ospf": ("OSPF Diagnostic: ",
             "OSPF Troubleshooting Guide - State Machine Diagnostics, RFC 2328 OSPF State Machine Reference"),
    "layers": ("Layer ",
               "OSI Model Troubleshooting - Bottom-Up Methodology, Chapter: Layer-by-Layer Diagnostic Sequence"),
}

# Diagnostic steps (route, position, check, commands, expected, on failure).
DIAGNOSTICS = [
    ("bgp_neighbor_down", 1, "Verify BGP configuration on both routers",
     ["show bgp neighbors", "show running-config | section bgp"],
     "BGP neighbor address, AS number, and router-id configured correctly",
     "Correct BGP configuration - check remote-as, neighbor address, local-as"),
    ("bgp_neighbor_down", 2, "Verify TCP port 179 connectivity",
     ["telnet <neighbor-ip> 179", "show ip sockets", "debug ip tcp transactions"],
     "TCP connection can be established to port 179",
     "Check ACLs blocking port 179, firewall rules, route to neighbor"),
    ("bgp_neighbor_down", 3, "Verify IP reachability to neighbor",
     ["ping <neighbor-ip> source <local-interface>", "show ip route <neighbor-ip>"],
     "Successful ping with correct source IP",
     "Fix routing to neighbor - add static route or ensure IGP reachability"),
    ("bgp_neighbor_down", 4, "Check for authentication mismatch",
     ["show bgp neighbors | include password", "debug ip bgp <neighbor-ip> events"],
     "MD5 authentication enabled and matching on both ends",
     "Configure matching MD5 password: neighbor <ip> password <key>"),
    ("bgp_route_missing", 1, "Verify route exists in BGP table",
     ["show bgp ipv4 unicast <prefix>", "show ip bgp <prefix>"],
     "Route present in BGP table with valid next-hop",
     "Route not received - check neighbor advertisements and prefix-lists"),
    ("bgp_route_missing", 2, "Check BGP best path selection",
     ["show bgp ipv4 unicast <prefix>", "debug ip bgp <prefix> bestpath"],
     "Route marked with > (best) and * (valid)",
     "Review best path selection criteria - weight, local preference, AS path, MED"),
    ("bgp_route_missing", 3, "Verify next-hop reachability",
     ["show bgp ipv4 unicast <prefix>", "show ip route <next-hop>"],
     "Next-hop IP is reachable in routing table",
     "Add next-hop-self or ensure IGP carries next-hop route"),
    ("bgp_route_missing", 4, "Check inbound route policies",
     ["show bgp neighbors <ip> policy", "show route-map <name>"],
     "Inbound route-map/prefix-list not filtering the route",
     "Modify route policy to permit the prefix"),
    ("ospf_exstart", 1, "Verify MTU settings on both interfaces",
     ["show interface <int>", "show ip ospf interface <int>"],
     "MTU values match on both ends", None),
    ("ospf_exstart", 2, "Verify OSPF Hello parameters match", ["show ip ospf interface <int>"],
     "Hello interval and Dead interval match on both ends", None),
    ("ospf_exstart", 3, "Verify Area type matches", ["show ip ospf", "show ip ospf interface"],
     "Both routers in same area with same area type (stub, NSSA, etc.)", None),
    ("ospf_exstart", 4, "Check for duplicate Router IDs", ["show ip ospf | include Router ID"],
     "All routers have unique router IDs in the OSPF domain", None),
    ("ospf_neighbor_down", 1, "Check physical/data link layer",
     ["show interface <int>", "show ip interface brief"],
     "Interface up/up, no input errors", None),
    ("ospf_neighbor_down", 2, "Verify OSPF is enabled on interface",
     ["show ip ospf interface <int>"], "Interface shows OSPF enabled", None),
    ("ospf_neighbor_down", 3, "Check OSPF area authentication",
     ["show ip ospf | include authentication"], "Authentication type matches on both ends", None),
    ("ospf_neighbor_down", 4, "Look at syslog for reason", ["show log | include OSPF"],
     "Find specific failure reason in logs", None),
]

# Layers (number, name, checks, commands); a step shows the first three checks.
LAYERS = [
    (1, "Physical", ["Interface status (show interface brief)", "Cable connections", "SFP/optics installed"],
     ["show interface <int>", "show controllers <int>"]),
    (2, "Data Link", ["VLAN membership correct", "Trunk configuration", "MAC address learning"],
     ["show mac address-table", "show spanning-tree", "show vlan brief", "show interface <int> trunk"]),
    (3, "Network", ["IP address assigned and correct subnet", "Default gateway configured", "Route to destination exists"],
     ["show ip interface brief", "show ip route", "show ip access-lists", "ping <dest>"]),
    (4, "Transport", ["Port not filtered by firewall/ACL", "Service listening on correct port", "TCP/UDP stateful tracking"],
     ["telnet <ip> <port>", "show ip nat translations", "show conn (ASA)"]),
]
