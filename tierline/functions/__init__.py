"""Column expressions. Everything but ``walk``, ``markup`` and ``runs`` (Arrow passes) runs inside the JVM."""

from .bands import *  # noqa: F401,F403
from .contacts import *  # noqa: F401,F403
from .email import render_email  # noqa: F401
from .framework import framework_for, framework_rows, has_report_card_grades  # noqa: F401
from .grades import *  # noqa: F401,F403
from .links import *  # noqa: F401,F403
from .markup import elements  # noqa: F401
from .names import *  # noqa: F401,F403
from .news import *  # noqa: F401,F403
from .notices import *  # noqa: F401,F403
from .register import *  # noqa: F401,F403
from .text import clean_report_text  # noqa: F401
