"""Column layout of every table, as Spark DDL strings."""

SCHEMAS: dict[str, str] = {
    "employees": """
        id INT NOT NULL, first_name STRING NOT NULL, last_name STRING NOT NULL, title STRING NOT NULL,
        phone STRING NOT NULL, email STRING NOT NULL, gender STRING NOT NULL, birth_date DATE NOT NULL,
        date_of_employment DATE, termination_date DATE, emergency_contact_name STRING,
        emergency_contact_phone STRING, emergency_contact_relation STRING, address STRING,
        postal_code STRING, city STRING, image_url STRING, role STRING, bio STRING,
        has_permanent_position BOOLEAN, emoji STRING, hr_manager INT, profession_id STRING""",
    "customers": "id STRING NOT NULL, name STRING NOT NULL, tripletex_number INT",
    "projects": """
        id STRING NOT NULL, name STRING NOT NULL, billable STRING NOT NULL, customer STRING NOT NULL,
        active BOOLEAN NOT NULL, responsible INT, deductable BOOLEAN NOT NULL""",
    "time_entry": """
        id STRING NOT NULL, employee INT NOT NULL, creator INT NOT NULL, minutes INT,
        project STRING NOT NULL, date DATE NOT NULL, created TIMESTAMP_NTZ""",
    "staffing": "employee INT NOT NULL, project STRING NOT NULL, date DATE NOT NULL, percentage INT NOT NULL",
    "absence": "employee_id INT NOT NULL, date DATE NOT NULL, reason STRING NOT NULL, percentage INT NOT NULL",
    "holidays": "date DATE NOT NULL, name STRING NOT NULL",
    "paid_overtime": """
        id INT NOT NULL, employee INT NOT NULL, paid_date DATE, minutes INT NOT NULL,
        comment STRING NOT NULL, registered_date DATE NOT NULL""",
    "vacation_days": "employee_id INT NOT NULL, year INT NOT NULL, days_earnt DOUBLE NOT NULL, comment STRING",
    "invoice_balance": """
        id STRING NOT NULL, project STRING NOT NULL, date DATE NOT NULL, amount DECIMAL(10,2) NOT NULL,
        minutes INT NOT NULL, created DATE NOT NULL, invoicenumber STRING, status STRING NOT NULL""",
    "expense": """
        id STRING NOT NULL, invoice_balance STRING NOT NULL, type STRING NOT NULL,
        amount DECIMAL(10,2) NOT NULL, created DATE NOT NULL, comment STRING""",
    "write_off": "id STRING NOT NULL, invoice_balance STRING NOT NULL, minutes INT NOT NULL, created DATE NOT NULL",
    "timelock_events": """
        id STRING NOT NULL, created TIMESTAMP_NTZ, creator INT NOT NULL, employee INT NOT NULL,
        commit_date DATE NOT NULL""",
    "employee_role": "id STRING NOT NULL, employee_id INT NOT NULL, role_type STRING NOT NULL, created DATE",
    "employee_tenure_role": """
        id STRING NOT NULL, from_date DATE NOT NULL, to_date DATE, employee_id INT NOT NULL,
        tenure_role STRING NOT NULL, created TIMESTAMP_NTZ""",
    "reporting_visibility": """
        year INT NOT NULL, week INT NOT NULL, available_hours DOUBLE NOT NULL,
        billable_hours DOUBLE NOT NULL, unavailable_hours DOUBLE NOT NULL, time_created TIMESTAMP_NTZ NOT NULL""",
    # Tables that only the contract report looks at.
    "talks": """
        employee INT, talk_date DATE NOT NULL, title STRING NOT NULL, description STRING,
        location STRING NOT NULL, created TIMESTAMP_NTZ NOT NULL, id INT NOT NULL""",
    "project_sdg_events": """
        event_id INT NOT NULL, event_type STRING NOT NULL, created_at TIMESTAMP_NTZ NOT NULL,
        caused_by INT NOT NULL, project STRING NOT NULL, goal INT NOT NULL""",
    "time_entry_comments": """
        id STRING NOT NULL, employee INT NOT NULL, creator INT NOT NULL, comment STRING NOT NULL,
        project STRING NOT NULL, date DATE NOT NULL, created TIMESTAMP_NTZ""",
    "invoice_lock_events": """
        id STRING NOT NULL, project_id STRING NOT NULL, creator_id INT NOT NULL,
        created_at TIMESTAMP_NTZ NOT NULL, order_id INT NOT NULL, commit_date DATE NOT NULL""",
    "ranked_games": "id STRING NOT NULL, title STRING NOT NULL",
    "ranked_matchups": """
        id STRING NOT NULL, game_id STRING NOT NULL, user1_id INT NOT NULL, user2_id INT NOT NULL,
        matchup_result STRING NOT NULL, created_at TIMESTAMP_NTZ NOT NULL""",
    "employee_settings": """
        employee_id INT NOT NULL, slack BOOLEAN NOT NULL, delegate BOOLEAN NOT NULL,
        deadline BOOLEAN NOT NULL, week_before_deadline BOOLEAN NOT NULL,
        termination BOOLEAN NOT NULL, hired BOOLEAN NOT NULL""",
    "employee_task": """
        id STRING NOT NULL, task_id STRING NOT NULL, completed BOOLEAN NOT NULL, employee_id INT NOT NULL,
        responsible_id INT NOT NULL, due_date TIMESTAMP_NTZ NOT NULL, completed_date TIMESTAMP_NTZ,
        completed_by_id INT""",
    "employee_task_comments": """
        id STRING NOT NULL, text STRING NOT NULL, created_at TIMESTAMP_NTZ NOT NULL,
        created_by_id INT NOT NULL, employee_task_id STRING NOT NULL""",
    "notification": """
        id STRING NOT NULL, employee_id INT NOT NULL, created_by INT, created_at TIMESTAMP_NTZ NOT NULL,
        read BOOLEAN NOT NULL, description STRING NOT NULL""",
    "phase": """
        id STRING NOT NULL, title STRING NOT NULL, process_template_id STRING NOT NULL,
        created_at TIMESTAMP_NTZ NOT NULL, due_date_day_offset INT, due_date TIMESTAMP_NTZ,
        active BOOLEAN NOT NULL""",
    "process_template": "title STRING NOT NULL, slug STRING NOT NULL",
    "profession": "slug STRING NOT NULL, title STRING NOT NULL",
    "profession_task": "profession_id STRING NOT NULL, task_id STRING NOT NULL",
    "task": """
        id STRING NOT NULL, title STRING NOT NULL, description STRING, link STRING, global BOOLEAN NOT NULL,
        phase_id STRING, responsible_id INT, created_at TIMESTAMP_NTZ NOT NULL, active BOOLEAN NOT NULL,
        due_date_day_offset INT, due_date TIMESTAMP_NTZ, responsible_type STRING NOT NULL""",
}
