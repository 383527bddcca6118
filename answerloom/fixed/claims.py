"""The claims an answer is compared with.

A claim is (domain, claim, pattern on lower-cased text, words that make it apply).
"""

# Fixed values.
CLAIMS = [
    ("topology", "collapsed_core_50_to_100_branch",
     r"50.{0,10}100.{0,30}branch|branch.{0,30}50.{0,10}100", ["collapsed core", "two-tier"]),
    ("topology", "spine_leaf_east_west", r"east.{0,10}west|east-west", ["spine", "leaf"]),
    ("bgp", "bgp_next_hop_requirement",
     r"next.hop.{0,30}unreachable|next.hop.{0,30}inaccessible", ["bgp", "route"]),
    ("bgp", "bgp_network_exact_match",
     r"exact match|exact prefix|network.{0,30}routing table", ["bgp", "network command"]),
    ("ospf", "totally_stubby_blocks_type3",
     r"type.?3.{0,30}block|block.{0,30}type.?3", ["totally stubby", "nssa"]),
    ("ospf", "abr_null0_discard",
     r"null.?0.{0,30}discard|discard.{0,30}null", ["abr", "summarization"]),
    ("qos", "classify_at_edge",
     r"classify.{0,30}edge|edge.{0,30}classify|trust boundary", ["qos", "classification"]),
    ("qos", "shaping_buffers_policing_drops",
     r"shaping.{0,50}buffer|policing.{0,50}drop|buffer.{0,50}shaping", ["qos"]),
    ("mpls", "rd_uniqueness_rt_distribution",
     r"rd.{0,30}unique|route distinguisher.{0,30}unique", ["mpls", "vpn"]),
    ("mpls", "vrf_isolation",
     r"vrf.{0,30}isolat|separate routing table|independent routing", ["vrf"]),
    ("ha", "fhrp_default_gateway",
     r"first.hop.redundancy|fhrp|default gateway.{0,30}redundanc",
     ["ha", "redundancy", "gateway"]),
    ("ha", "glbp_multiple_vms",
     r"multiple.{0,30}virtual mac|avg|avf|active virtual", ["glbp"]),
    ("sdwan", "bfd_application_aware",
     r"bfd.{0,50}latency|bfd.{0,50}jitter|application.aware.routing", ["sd-wan", "bfd"]),
    ("sdwan", "full_mesh_formula",
     r"n.{0,5}\(.{0,5}n.{0,5}-.{0,5}1.{0,5}\).{0,10}/\s*2|n\(n-1\)/2",
     ["full mesh", "topology"]),
    ("vxlan", "vtep_underlay_ip_reachability",
     r"vtep.{0,30}ip|underlay.{0,30}vtep|ospf.{0,30}underlay", ["vxlan", "vtep"]),
    ("vxlan", "vxlan_50_byte_overhead",
     r"50.{0,20}byte|50 byte overhead|vxlan.{0,30}overhead", ["vxlan", "mtu"]),
    ("methodology", "business_drives_technology",
     r"business.{0,30}drive|business.{0,30}technolog|top.?down", ["design", "requirement"]),
]
