"""Fixed values of the oracle, restated here so that it doesn't share them
with the library under test."""

# fixed values: tickets left out of the encounter report
TICKETS = [
    '000347', '000842A', '006186', '010976', '021547', '023971', '033918', '043091', '045260A', '051951',
    '054196', '057663', '057664', '057665', '057666', '061326', '002746', '004112', '005342', '006032',
    '012802', '013967', '013973', '016045', '016206', '017547', '018425', '019487', '020016', '020685',
    '020713', '021249', '021546', '026112', '027993', '028781', '029520', '031820', '033010', '033377',
    '044270', '045973', '051922', '051966', '051991', '054189', '056586', '056587', '057476', '057625',
    '057643', '059386', '061308', '061312', '061313', '061314', '062677', '063810', '063811', '063816',
    '063819', '063821', '063829', '063835', '063836', '063840', '063848', '079063', '000236', '000637',
    '001189', '001210', '001211', '001884', '002118', '002222A', '004680', '008323', '008673', '011702',
    '012921', '013322', '013868', '013950', '016196', '016449', '017509', '021799', '023132', '023968',
    '023990', '024005', '024981', '028422', '033069', '033332', '035577', '039397', '042398', '043316',
    '046141', '046142', '046235', '048285', '051929', '051932', '051934', '051936', '051957', '051960',
    '051980', '052012', '052017', '052028', '052694', '052696', '054190', '054236', '056055', '057638',
    '057644', '057672', '058772', '058829', '058839', '060536', '060546', '060581', '060701', '061323',
    '063306', '063404', '063405', '063846', '063856', '045265', '059952',
]

# parameters of the filtered report variants
ENCOUNTER_LISTS = {
    "doctor_id": [0, 2, 3, 5, 7, 9],
    "facility_id": [1000000, 1000002, 1000004, 1000006, 1000008, 1000010, 1000012, 1000014, 1000016, 1000018, 1000020, 1000022, 1000024],
    "company_id": [2000000, 2000001, 2000003, 2000004],
    "carrier_id": [1, 4, 7, 10, 13, 16, 19, 22],
    "batch_id": [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44],
}
ENCOUNTER_RESOURCES = [0, 1, 2, 4, 6, 7, 9]
JOURNAL_LISTS = {
    "facility_id": [1000001, 1000004, 1000009, 1000016, 1000021],
    "carrier_id": [0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24],
}
