"""Names and constants that flow tables must share with trained models.

Everything in this module is a fixed value: column names, candidate names and
thresholds that decide whether two systems read the same table the same way.
"""

# --- fixed values: ordered feature contract (80 names) ---
FEATURES = [
    "source port",
    "destination port",
    "protocol",
    "flow duration",
    "total fwd packets",
    "total backward packets",
    "total length of fwd packets",
    "total length of bwd packets",
    "fwd packet length max",
    "fwd packet length min",
    "fwd packet length mean",
    "fwd packet length std",
    "bwd packet length max",
    "bwd packet length min",
    "bwd packet length mean",
    "bwd packet length std",
    "flow bytes/s",
    "flow packets/s",
    "flow iat mean",
    "flow iat std",
    "flow iat max",
    "flow iat min",
    "fwd iat total",
    "fwd iat mean",
    "fwd iat std",
    "fwd iat max",
    "fwd iat min",
    "bwd iat total",
    "bwd iat mean",
    "bwd iat std",
    "bwd iat max",
    "bwd iat min",
    "fwd psh flags",
    "bwd psh flags",
    "fwd urg flags",
    "bwd urg flags",
    "fwd header length",
    "bwd header length",
    "fwd packets/s",
    "bwd packets/s",
    "min packet length",
    "max packet length",
    "packet length mean",
    "packet length std",
    "packet length variance",
    "fin flag count",
    "syn flag count",
    "rst flag count",
    "psh flag count",
    "ack flag count",
    "urg flag count",
    "cwe flag count",
    "ece flag count",
    "down/up ratio",
    "average packet size",
    "avg fwd segment size",
    "avg bwd segment size",
    "fwd header length.1",
    "fwd avg bytes/bulk",
    "fwd avg packets/bulk",
    "fwd avg bulk rate",
    "bwd avg bytes/bulk",
    "bwd avg packets/bulk",
    "bwd avg bulk rate",
    "subflow fwd packets",
    "subflow fwd bytes",
    "subflow bwd packets",
    "subflow bwd bytes",
    "init_win_bytes_forward",
    "init_win_bytes_backward",
    "act_data_pkt_fwd",
    "min_seg_size_forward",
    "active mean",
    "active std",
    "active max",
    "active min",
    "idle mean",
    "idle std",
    "idle max",
    "idle min",
]

# --- fixed values: identification columns written before the features ---
FLOW_METADATA = ["flow id", "source ip", "destination ip", "timestamp", "label"]
CONVERTER_METADATA = [
    "flow id", "source ip", "source port", "destination ip",
    "destination port", "protocol", "timestamp", "label",
]

# --- fixed values: Java flow meter header -> contract name (23 renames) ---
JAVA_METER_RENAMES = {
    "src ip": "source ip",
    "dst ip": "destination ip",
    "src port": "source port",
    "dst port": "destination port",
    "total fwd packet": "total fwd packets",
    "total bwd packets": "total backward packets",
    "total length of fwd packet": "total length of fwd packets",
    "total length of bwd packet": "total length of bwd packets",
    "packet length min": "min packet length",
    "packet length max": "max packet length",
    "cwr flag count": "cwe flag count",
    "fwd segment size avg": "avg fwd segment size",
    "bwd segment size avg": "avg bwd segment size",
    "fwd bytes/bulk avg": "fwd avg bytes/bulk",
    "fwd packet/bulk avg": "fwd avg packets/bulk",
    "fwd bulk rate avg": "fwd avg bulk rate",
    "bwd bytes/bulk avg": "bwd avg bytes/bulk",
    "bwd packet/bulk avg": "bwd avg packets/bulk",
    "bwd bulk rate avg": "bwd avg bulk rate",
    "fwd init win bytes": "init_win_bytes_forward",
    "bwd init win bytes": "init_win_bytes_backward",
    "fwd act data pkts": "act_data_pkt_fwd",
    "fwd seg size min": "min_seg_size_forward",
}

# --- fixed values: Python flow meter header -> contract name (79 columns) ---
PY_METER_COLUMNS = {
    "src_port": "source port",
    "dst_port": "destination port",
    "protocol": "protocol",
    "flow_duration": "flow duration",
    "tot_fwd_pkts": "total fwd packets",
    "tot_bwd_pkts": "total backward packets",
    "totlen_fwd_pkts": "total length of fwd packets",
    "totlen_bwd_pkts": "total length of bwd packets",
    "fwd_pkt_len_max": "fwd packet length max",
    "fwd_pkt_len_min": "fwd packet length min",
    "fwd_pkt_len_mean": "fwd packet length mean",
    "fwd_pkt_len_std": "fwd packet length std",
    "bwd_pkt_len_max": "bwd packet length max",
    "bwd_pkt_len_min": "bwd packet length min",
    "bwd_pkt_len_mean": "bwd packet length mean",
    "bwd_pkt_len_std": "bwd packet length std",
    "flow_byts_s": "flow bytes/s",
    "flow_pkts_s": "flow packets/s",
    "flow_iat_mean": "flow iat mean",
    "flow_iat_std": "flow iat std",
    "flow_iat_max": "flow iat max",
    "flow_iat_min": "flow iat min",
    "fwd_iat_tot": "fwd iat total",
    "fwd_iat_mean": "fwd iat mean",
    "fwd_iat_std": "fwd iat std",
    "fwd_iat_max": "fwd iat max",
    "fwd_iat_min": "fwd iat min",
    "bwd_iat_tot": "bwd iat total",
    "bwd_iat_mean": "bwd iat mean",
    "bwd_iat_std": "bwd iat std",
    "bwd_iat_max": "bwd iat max",
    "bwd_iat_min": "bwd iat min",
    "fwd_psh_flags": "fwd psh flags",
    "bwd_psh_flags": "bwd psh flags",
    "fwd_urg_flags": "fwd urg flags",
    "bwd_urg_flags": "bwd urg flags",
    "fwd_header_len": "fwd header length",
    "bwd_header_len": "bwd header length",
    "fwd_pkts_s": "fwd packets/s",
    "bwd_pkts_s": "bwd packets/s",
    "pkt_len_min": "min packet length",
    "pkt_len_max": "max packet length",
    "pkt_len_mean": "packet length mean",
    "pkt_len_std": "packet length std",
    "pkt_len_var": "packet length variance",
    "fin_flag_cnt": "fin flag count",
    "syn_flag_cnt": "syn flag count",
    "rst_flag_cnt": "rst flag count",
    "psh_flag_cnt": "psh flag count",
    "ack_flag_cnt": "ack flag count",
    "urg_flag_cnt": "urg flag count",
    "cwr_flag_count": "cwe flag count",
    "ece_flag_cnt": "ece flag count",
    "down_up_ratio": "down/up ratio",
    "pkt_size_avg": "average packet size",
    "fwd_seg_size_avg": "avg fwd segment size",
    "bwd_seg_size_avg": "avg bwd segment size",
    "fwd_byts_b_avg": "fwd avg bytes/bulk",
    "fwd_pkts_b_avg": "fwd avg packets/bulk",
    "fwd_blk_rate_avg": "fwd avg bulk rate",
    "bwd_byts_b_avg": "bwd avg bytes/bulk",
    "bwd_pkts_b_avg": "bwd avg packets/bulk",
    "bwd_blk_rate_avg": "bwd avg bulk rate",
    "subflow_fwd_pkts": "subflow fwd packets",
    "subflow_fwd_byts": "subflow fwd bytes",
    "subflow_bwd_pkts": "subflow bwd packets",
    "subflow_bwd_byts": "subflow bwd bytes",
    "init_fwd_win_byts": "init_win_bytes_forward",
    "init_bwd_win_byts": "init_win_bytes_backward",
    "fwd_act_data_pkts": "act_data_pkt_fwd",
    "fwd_seg_size_min": "min_seg_size_forward",
    "active_mean": "active mean",
    "active_std": "active std",
    "active_max": "active max",
    "active_min": "active min",
    "idle_mean": "idle mean",
    "idle_std": "idle std",
    "idle_max": "idle max",
    "idle_min": "idle min",
}
PY_METER_METADATA = {
    "src_ip": "source ip",
    "dst_ip": "destination ip",
    "timestamp": "timestamp",
}

# --- fixed values: features measured in time units ---
DURATION_FEATURES = [
    "flow duration",
    "flow iat mean",
    "flow iat std",
    "flow iat max",
    "flow iat min",
    "fwd iat total",
    "fwd iat mean",
    "fwd iat std",
    "fwd iat max",
    "fwd iat min",
    "bwd iat total",
    "bwd iat mean",
    "bwd iat std",
    "bwd iat max",
    "bwd iat min",
    "active mean",
    "active std",
    "active max",
    "active min",
    "idle mean",
    "idle std",
    "idle max",
    "idle min",
]

# --- fixed values: feature that repeats another one ---
DUPLICATE_OF = ("fwd header length", "fwd header length.1")

# --- fixed values: bulk features, always zero ---
BULK_FEATURES = [
    "fwd avg bytes/bulk",
    "fwd avg packets/bulk",
    "fwd avg bulk rate",
    "bwd avg bytes/bulk",
    "bwd avg packets/bulk",
    "bwd avg bulk rate",
]

# --- fixed values: candidate column names, first match wins ---
SRC_IP_CANDIDATES = ["src ip", "src_ip", "source ip", "source_ip", "ip src", "ip_src"]
TRAIN_LABEL_CANDIDATES = ["label", "class", "attack", "category", "result"]
TRAIN_LABEL_SUBSTRINGS = ["label", "attack"]
EVAL_LABEL_CANDIDATES = ["label", "class", "attack", "category"]
TIME_CANDIDATES = ["timestamp", "flow start", "starttime", "start time", "flowstart", "start"]

# --- fixed values: addresses that are never blocked ---
ALWAYS_ALLOWED = ["127.0.0.1", "0.0.0.0", "::1"]

# --- fixed values: thresholds tried by a sweep ---
SWEEP_THRESHOLDS = [
    0.001, 0.005, 0.01, 0.02, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.90,
]

# --- fixed values: numeric limits ---
CLIP_LIMIT = 1e12
SIGMOID_CLIP = 40.0
ACTIVITY_TIMEOUT_US = 5_000_000
FLOW_TIMEOUT_US = 120_000_000
SYNTHETIC_TIME_BASE = "2017-06-01 00:00:00"
TRAIN_FRACTION = 0.70
VALIDATION_FRACTION = 0.15
DEFAULT_THRESHOLD = 0.5

# --- fixed values: TCP flag bits ---
TCP_FLAGS = {
    "fin": 0x01,
    "syn": 0x02,
    "rst": 0x04,
    "psh": 0x08,
    "ack": 0x10,
    "urg": 0x20,
    "ece": 0x40,
    "cwr": 0x80,
}

# --- fixed values: IP protocol numbers ---
PROTO_ICMP, PROTO_TCP, PROTO_UDP = 1, 6, 17
