"""Formats of the log lines that are read, as Java regular expressions.

Every pattern is anchored at both ends where it is used with `extract`, and no alternation stands under * or +, so that
lines of any length match without deep recursion.
"""

# Month names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Line headers.
BSD_HEADER = r"(?s)^(\w{3})\s+(\d+)\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"
ISO_HEADER = r"(?s)^(\d{4}-\d{2}-\d{2}T\S+?)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"
KERNEL_HEADER = r"(?s)^(\d{4}-\d{2}-\d{2}T\S+?)\s+(\S+)\s+kernel(?:\[(\d+)\])?:\s*(.*)$"

# Messages of the log-in services, in the order in which they are tried: event, pattern, what its groups are.
IP = r"([\d.:a-fA-F]+)"
SSHD_EVENTS = [
    ("sshd_invalid_user", rf"^Invalid user (\S+) from {IP} port (\d+)", ("user", "src_ip", "port")),
    ("sshd_accepted_password", rf"^Accepted password for (\S+) from {IP} port (\d+)", ("user", "src_ip", "port")),
    ("sshd_accepted_publickey", rf"^Accepted publickey for (\S+) from {IP} port (\d+)", ("user", "src_ip", "port")),
    ("sshd_failed_password", rf"^Failed password for (?:invalid user )?(\S+) from {IP} port (\d+)", ("user", "src_ip", "port")),
    ("sshd_conn_closed", rf"^Connection closed by (?:(?:authenticating|invalid) user (\S+) )?{IP} port (\d+)", ("user", "src_ip", "port")),
    ("sshd_conn_reset", rf"^Connection reset by (?:(?:authenticating|invalid) user (\S+) )?{IP} port (\d+)", ("user", "src_ip", "port")),
    ("sshd_disconnected", rf"^Disconnected from (?:(?:authenticating|invalid) user (\S+) )?{IP} port (\d+)", ("user", "src_ip", "port")),
    ("sshd_no_id_string", rf"^Did not receive identification string from {IP} port (\d+)", ("src_ip", "port")),
    ("sshd_kex_error", r"^error: kex_exchange_identification: (.+)", ("detail",)),
    ("sshd_banner_exchange", rf"^banner exchange: Connection from {IP} port (\d+): (.+)", ("src_ip", "port", "detail")),
    ("sshd_unable_negotiate", rf"^Unable to negotiate with {IP} port (\d+): (.+)", ("src_ip", "port", "detail")),
    ("sshd_max_auth", rf"^error: maximum authentication attempts exceeded for (?:invalid user )?(\S+) from {IP} port (\d+)", ("user", "src_ip", "port")),
    ("sshd_session_opened", r"^pam_unix\(sshd:session\): session opened for user (\S+)", ("user",)),
    ("sshd_session_closed", r"^pam_unix\(sshd:session\): session closed for user (\S+)", ("user",)),
]
SUDO_EVENTS = [
    ("sudo_command", r"^(\S+)\s*:\s*TTY=(\S+)\s*;\s*PWD=([^;]+)\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.+)", ("user", None, None, None, "detail")),
    ("sudo_auth_failure", r"^pam_unix\(sudo:auth\): authentication failure.*user=(\S+)", ("user",)),
]
CRON_LOGIN_EVENTS = [
    ("cron_session_opened", r"^pam_unix\(cron:session\): session opened for user (\S+)", ("user",)),
    ("cron_session_closed", r"^pam_unix\(cron:session\): session closed for user (\S+)", ("user",)),
]
SU_EVENTS = [
    ("su_to", r"^\(to (\S+)\) (\S+) on (\S+)", ("detail", "user", None)),
    ("su_session_opened", r"^pam_unix\(su(?:-l)?:session\): session opened for user (\S+)", ("user",)),
    ("su_session_closed", r"^pam_unix\(su(?:-l)?:session\): session closed for user (\S+)", ("user",)),
]

# Messages of cron, in the order in which they are tried.
CRON_EVENTS = [
    ("CMD", r"^\((\S+)\)\s+CMD\s+\((.+)\)$", ("user", "detail")),
    ("SESSION_OPEN", r"pam_\w+\(cron:session\):\s+session\s+opened\s+for\s+user\s+(\S+)", ("user",)),
    ("SESSION_CLOSE", r"pam_\w+\(cron:session\):\s+session\s+closed\s+for\s+user\s+(\S+)", ("user",)),
    ("ERROR", r"^\((\S+)\)\s+(?:ERROR|error)\s+\((.+)\)$", ("user", "detail")),
    ("MAIL", r"^\((\S+)\)\s+MAIL\s+\((.+)\)$", ("user", "detail")),
    ("INFO", r"^\((\S+)\)\s+INFO\s+\((.+)\)$", ("user", "detail")),
    ("RELOAD", r"^\((\S+)\)\s+RELOAD\s+\((.+)\)$", ("user", "detail")),
    ("STARTUP", r"^\((\S+)\)\s+STARTUP\s+\((.+)\)$", ("user", "detail")),
]

# Web server lines. Inside quotes a backslash escapes the next character.
QUOTED = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
ACCESS = rf'(?s)^\s*(\S+)[^\[]*\[([^\]]+)\]\s+"({QUOTED})"\s+(\d{{3}})\s+(\S+)(.*)$'
VHOST_ACCESS = rf'(?s)^\s*(\S+?:\d+)\s+(\S+)[^\[]*\[([^\]]+)\]\s+"({QUOTED})"\s+(\d{{3}})\s+(\S+)(.*)$'
REQUEST = r"^(\S+)\s+(\S+)\s+(\S+)$"
ACCESS_TIME = r"^(\d{2})/(\w{3})/(\d{4}):(\d{2}:\d{2}:\d{2}).*$"
APACHE_ERROR_24 = r"^\[\w+ (\w+ \d{1,2} [\d:.]+\s+\d{4})\] \[([^:]+):(\w+)\] \[pid (\d+)\](?: \[client ([^\]]+)\])? (.+)$"
APACHE_ERROR_22 = r"^\[\w+ (\w+ \d{1,2} [\d:]+\s+\d{4})\] \[(\w+)\](?: \[client ([^\]]+)\])? (.+)$"
APACHE_ERROR_TIME = r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})(?:\.\d+)?\s+(\d{4}).*$"
NGINX_ERROR = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (\d+)#(\d+):(?: \*(\d+))? (.+)$"
NGINX_CLIENT = r"client:\s*([\d.:a-fA-F]+)"

# Database lines.
MYSQL_HEADER_LINE = r"^(?:/usr/sbin/mysqld|Tcp port|Time\s+Id\s+Command)"
MYSQL_QUERY = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\S*)\t\s*(\d+)\s+(\S+)(?:\t(.*))?$"
MYSQL_ERROR = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\S*)\s+(\d+)\s+\[(\w+)\]\s+\[([^\]]+)\]\s+\[([^\]]+)\]\s+(.*)$"
MYSQL_TIME = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.(\d+))?.*$"

# Shell histories and audit headers.
ZSH_EXTENDED = r"(?s)^:\s*(\d+):(\d+);(.*)$"
AUDIT_STAMP = r"audit\(([\d.]+):(\d+)\)"
